import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokenize_keeps_order_and_repeats(spark):
    assert one(spark, tx.tokenize("t"), t="How the Cat, the cat's 2nd-rate CAT") == ["cat", "cat", "s", "2nd", "rate", "cat"]
    assert one(spark, tx.tokenize("t"), t="café") == ["caf"]


def test_slugs(spark):
    assert [one(spark, tx.section_slug("t"), t=t) for t in ("Refund Policy!", "##", "--a--b--")] == ["refund-policy", "section", "a-b"]
    assert one(spark, tx.file_slug("t"), t="x" * 63 + " y") == "x" * 63
    assert one(spark, tx.file_slug("t"), t="¿?") == "answer"


def test_normalize_and_hash(spark):
    composed, decomposed = "café\nx", "café\r\nx"
    assert one(spark, tx.normalize("t"), t=decomposed) == composed
    assert one(spark, tx.content_hash(tx.normalize("t")), t=decomposed) == hashlib.sha256(composed.encode()).hexdigest()


def test_context_and_embedded_text(spark):
    df = spark.createDataFrame([(["A", " ", "B"], "H", "body")], "p array<string>, h string, c string")
    assert df.select(tx.embedded_text(tx.heading_context("p", "h"), "c")).first()[0] == "A > B\n\nbody"
    df = spark.createDataFrame([([], " H ", "body")], "p array<string>, h string, c string")
    assert df.select(tx.embedded_text(tx.heading_context("p", "h"), "c")).first()[0] == "H\n\nbody"


def test_preview_strip_parent(spark):
    assert one(spark, tx.preview("t"), t="  a \n b  ") == "a b"
    assert one(spark, tx.strip("t"), t="  x \x85") == "x"
    assert one(spark, tx.parent_of("t"), t="f#a::chunk-1::chunk-12") == "f#a::chunk-1"


def test_terms_and_bounded(spark):
    assert one(spark, tx.expanded_terms(F.array(*map(F.lit, ("address", "gas", "cats", "cats"))))) == ["address", "gas", "cats", "addres", "cat"]
    assert [one(spark, tx.bounded(F.lit(x))) for x in (1.0, 0.0, -1.0, float("inf"), float("nan"), None)] == [0.5, 0, 0, 0, 0, 0]


def test_hash_embedding(spark):
    tokens = F.array(*map(F.lit, ("cats", "run")))
    assert one(spark, tx.hash_features(tokens)) == ["cats", "run", "cat", "cats_run"]
    assert one(spark, tx.hash_features(F.array(F.lit("a1")))) == ["a1"]
    assert one(spark, tx.hash_features(F.array().cast("array<string>"))) == []
    assert one(spark, tx.hash_bucket(F.lit("cats_run"))) == int.from_bytes(hashlib.sha256(b"cats_run").digest()[:4], "big") % 256


def test_token_hash(spark):
    want = hashlib.sha256(json.dumps(sorted([["b", 2], ["a", 1]]), separators=(",", ":")).encode()).hexdigest()
    assert one(spark, tx.token_hash(F.array(*map(F.lit, "bab")))) == want


def test_l2_normalize(spark):
    assert one(spark, tx.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, tx.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]


def test_headings_are_compared_in_nfc(spark):
    from quillspark.operators import chunking

    forms = ["Cafe\u0301 au lait", "Caf\u00e9 au lait"]
    df = spark.createDataFrame([(f"f#{k}", "f.md", h, ["T", h], "text") for k, h in enumerate(forms)], "id string, file string, heading string, heading_path array<string>, content string")
    assert len({r["content_hash"] for r in chunking.children(df).collect()}) == 1
    assert len({r["embedding_text"] for r in chunking.children(df).collect()}) == 1
