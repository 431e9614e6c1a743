import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import tokenize
from quillspark.operators import chunking, identity, incremental, ranking
from quillspark.operators.identity import Namespace, canonical_url
from quillspark.sources import embeddings, json_files


def kids(spark, *texts):
    df = spark.createDataFrame([(f"f.md#{k}", "f.md", "H", ["T", "é"], t) for k, t in enumerate(texts)], "id string, file string, heading string, heading_path array<string>, content string")
    return chunking.children(df)


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://user:secret@Example.COM.:443//v1/./a/../?key=1#x", "https://example.com/v1"),
        ("http://h:8080/", "http://h:8080"),
        ("http://[::1]:80/x/", "http://[::1]/x"),
        ("https://bücher.example/v1", "https://xn--bcher-kva.example/v1"),
    ],
)
def test_canonical_url(url, want):
    assert canonical_url(url) == want


@pytest.mark.parametrize("url", ["", "ftp://x", "/v1", "http://", "http://a b", 7, "http://x:99999"])
def test_bad_urls(url):
    with pytest.raises(ValueError):
        canonical_url(url)


def test_namespace():
    a = Namespace("Kind", " model ", "https://x/v1/", 8)
    assert a.fingerprint == Namespace("kind", "model", "https://x/v1", 8).fingerprint == hashlib.sha256(a.canonical_json.encode()).hexdigest()
    assert a.fingerprint != Namespace("kind", "model", "https://x/v1", 9).fingerprint
    assert a.fingerprint != Namespace("kind", "model", "https://x/v1", 8, policy=chunking.ChunkingPolicy(900)).fingerprint
    for bad in ({"resolved_dimension": 0}, {"resolved_dimension": True}, {"provider_kind": "1x"}, {"embedding_model": "a\nb"}):
        with pytest.raises(ValueError):
            Namespace(**({"provider_kind": "k", "embedding_model": "m", "base_url": "https://x", "resolved_dimension": 8} | bad))


@pytest.mark.parametrize("bad", [{"embedding_model": "m" * 257}, {"requested_dimension": 0}, {"metric": ""}, {"base_url": "http://" + "x" * 2050}, {"embedding_model": None}])
def test_namespace_bounds(bad):
    good = {"provider_kind": "k", "embedding_model": "m" * 256, "base_url": "https://x", "resolved_dimension": 8}
    assert Namespace(**good).embedding_model == "m" * 256
    with pytest.raises(ValueError):
        Namespace(**(good | bad))


@pytest.mark.parametrize("bad", [{"separators": ()}, {"separators": ("x",) * 17}, {"separators": ("x" * 129,)}, {"size": 1_000_001}, {"overlap": 1000}])
def test_policy_bounds(bad):
    with pytest.raises(ValueError):
        chunking.ChunkingPolicy(**bad)


def test_register_once(spark):
    n = Namespace("k", "m", "https://x", 8)
    known = spark.createDataFrame([], "fingerprint string, canonical_json string")
    row = identity.register(known, n)
    assert row.count() == 1 and identity.register(row, n).count() == 0
    with pytest.raises(ValueError):
        identity.register(row.withColumn("canonical_json", F.lit("{}")), n)


def test_section_hash_is_of_sorted_json(spark):
    df = kids(spark, "text – x")
    r = df.first().asDict()
    want = {("id" if k == "chunk_id" else k): r[k] for k in identity.DIGEST_FIELDS}
    digest = hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert identity.child_identity(df).first()["section_hash"] == digest
    broken = df.withColumn("content_hash", F.lit("none"))
    assert (lambda x: x["content_hash"] == x["section_hash"])(identity.child_identity(broken).first())


def test_corpus_fingerprint_ignores_order_only(spark):
    a, b = (identity.child_identity(kids(spark, *t)) for t in (("x", "y"), ("x", "z")))
    f = identity.corpus_fingerprint
    assert f(a) == f(a.orderBy(F.desc("chunk_id")).repartition(3)) != f(b)


def test_vector_violations(spark):
    t = ranking.child_tokens(kids(spark, "red cat", "blue cat sat"))
    w, i = ranking.tfidf_weights(t), ranking.tfidf_idf(t)
    r = ranking.tfidf_norms(w)
    assert all(x["n"] == 0 for x in identity.vector_violations(r, w, i).collect())
    got = {x["check"]: x["n"] for x in identity.vector_violations(r.withColumn("norm", F.col("norm") + 1).union(r), w.withColumn("weight", -F.col("weight")), i.where("token <> 'red'")).collect()}
    assert got["duplicate id"] == 2 and got["wrong norm"] == 2 and got["token outside vocabulary"] == 1 and got["bad weight"] == w.count()


def test_manifest(spark):
    df, n = kids(spark, "x", "y"), Namespace("k", "m", "https://x", 8)
    good = {"dimension": 8, "chunks": 2, "sections": 2, "files": 1, "namespace": n.fingerprint, "corpus": identity.corpus_fingerprint(identity.child_identity(df))}
    identity.check_manifest(good, df, n)
    for k, v in (("chunks", 3), ("dimension", "8"), ("corpus", ""), ("namespace", "")):
        with pytest.raises(ValueError):
            identity.check_manifest(good | {k: v}, df, n)


def test_hash_provider_equals_the_columns(spark):
    texts = ["Cats run with cats", "", "the address"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", tokenize("t").alias("tokens"))
    counts = {}
    for r in ranking.hash_embeddings(df, 32).collect():
        counts.setdefault(r["id"], {})[r["bucket"]] = r["n"]
    for k, v in enumerate(embeddings.HashProvider(32).embed(texts)):
        norm = sum(n * n for n in counts.get(k, {}).values()) ** 0.5 or 1
        assert v == pytest.approx([counts.get(k, {}).get(b, 0) / norm for b in range(32)])


def test_embedding_uses_the_cache_and_searches(spark):
    p = embeddings.HashProvider(64)
    df = kids(spark, "refunds take five days", "shipping is standard")
    none = incremental.cache_rows(spark.createDataFrame([], "chunk_id string, source_id string, content_hash string, vector array<float>"), "x")
    rows = embeddings.embedded(df, none, p).persist()
    again = embeddings.embedded(df, rows, p)
    assert again.count() == rows.count() == 2 and incremental.cache_misses(df, rows, embeddings.namespace_of(p).fingerprint, 64).count() == 0
    q = embeddings.query_vectors(spark.createDataFrame([(0, "five days refunds")], "query_id long, query string"), p)
    ids = rows.select(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long").alias("id"), "vector")
    assert ranking.dense_topk(ids, q, 1).first()["id"] == 0


def test_json_index(spark, tmp_path):
    from quillspark.operators import markdown

    s = markdown.sections(spark.createDataFrame([("a.md", "## A\nx y\n## B\nz")], "file string, text string"))
    json_files.write_index(s, str(tmp_path / "i"))
    assert json_files.read_index(spark, str(tmp_path / "i"), s).count() == 2
    assert [r["id"] for r in json_files.read_index(spark, str(tmp_path / "i"), s.where("heading = 'A'")).collect()] == ["a.md#a"]
    json_files.write_wiki(s, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first()[0] == "## a.md"
    cards = spark.createDataFrame([("Why?", "because", ["a"])], "query string, final_answer string, sources array<string>")
    json_files.write_answer_cards(cards, str(tmp_path / "c"), "m")
    json_files.write_answer_cards(cards, str(tmp_path / "c"), "m")
    got = spark.read.json(str(tmp_path / "c"))
    assert got.count() == 2 and got.first()["name"].endswith("Z-why")


def test_stored_rows_are_compared_by_digest(spark):
    from quillspark.sources.json_files import same_rows

    a = spark.createDataFrame([("x", ["t"]), ("x", ["t"]), ("y", None)], "id string, tokens array<string>")
    assert same_rows(a, a.repartition(3)) and not same_rows(a, a.distinct()) and not same_rows(a, a.withColumn("tokens", F.coalesce("tokens", F.array())))
