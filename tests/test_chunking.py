import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking
from quillspark.operators.chunking import ChunkingPolicy

SCHEMA = "id string, file string, heading string, heading_path array<string>, content string"


def kids(spark, content, policy=ChunkingPolicy(), path=("T", "H")):
    df = spark.createDataFrame([("f#h", "f", "H", list(path), content)], SCHEMA)
    return [r.asDict() for r in chunking.children(df, policy).orderBy("chunk_index").collect()]


def test_short_text_is_one_child(spark):
    (r,) = kids(spark, "short")
    assert (r["chunk_id"], r["content"], r["embedding_text"], r["chunk_count"]) == ("f#h::chunk-0", "short", "T > H\n\nshort", 1)


def test_overlap_is_exact_without_separators(spark):
    got = kids(spark, "0123456789" * 32, ChunkingPolicy(80, 20, ("",)))
    assert all(len(r["content"]) <= 80 for r in got)
    assert all(a["content"][-20:] == b["content"][:20] for a, b in zip(got, got[1:]))
    assert [r["chunk_id"] for r in got] == [f"f#h::chunk-{k}" for k in range(len(got))]


def test_equal_hash_for_equal_normal_form(spark):
    assert kids(spark, "café\nx")[0]["content_hash"] == kids(spark, "café\r\nx")[0]["content_hash"]


def test_policy_is_checked():
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            ChunkingPolicy(*bad)


@pytest.mark.parametrize("size,overlap", [(20, 5), (41, 20), (80, 39)])
def test_expression_and_arrow_function_agree(spark, size, overlap):
    pick = random.Random(size)
    texts = ["".join(pick.choice("ab\n. 😀é") for _ in range(pick.randint(0, 300))) for _ in range(150)]
    policy = ChunkingPolicy(size, overlap)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("t", chunking.bounds("t", policy).alias("a"), chunking.bounds_udf(policy)("t").alias("b")).collect()
    for r in rows:
        assert [tuple(x) for x in r["a"]] == [tuple(x) for x in r["b"]]
        cuts = [tuple(x) for x in r["b"]]
        assert cuts[0][0] == 0 and cuts[-1][1] == len(r["t"]) and all(b[0] == a[1] - overlap for a, b in zip(cuts, cuts[1:]))


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(F.size(chunking.bounds_udf()("t"))).first()[0] in (-1, None)


def test_children_need_no_python_beside_nfc(spark):
    """The splitter's Arrow function held batches of whole texts in each Python worker; all that goes there is what NFC can change."""
    df = spark.createDataFrame([("a", "f", "H", ["H"], "x. y " * 999), ("b", "f", "H", ["H"], None)], SCHEMA)
    rows = chunking.children(df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "_nfc(" in plan and "run(" not in plan and plan.count("regexp_extract_all") == 1
    assert rows.groupBy("source_id").count().collect() == [("a", 6)]


@pytest.mark.parametrize("separators", [("\n\n", "\n", ". ", " "), (".\\E[", "x"), ("",)])
def test_long_texts_and_contents(spark, separators):
    """More pieces than are added up one by one, and contents made of two pieces."""
    pick = random.Random(5)
    texts = ["".join(pick.choice("ab\n. x😀é") + pick.choice(["", "", ".\\E["]) for _ in range(n)) for n in (0, 1, 40, 41, 9_000, 20_000)]
    policy = ChunkingPolicy(40, 9, separators)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", chunking.bounds("t", policy, content=True).alias("a"), chunking.bounds_udf(policy)("t").alias("b")).collect():
        assert [(x["start"], x["stop"]) for x in r["a"]] == [tuple(x) for x in r["b"]]
        assert [x["content"] for x in r["a"]] == [r["t"][x["start"] : x["stop"]] for x in r["a"]]
