"""Rows that are dealt as compressed tables, and the index that is built of them."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark import packed
from quillspark.operators import chunking, identity, ranking
from quillspark.sources import index_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 7, 1 << 19])
def test_rows_are_dealt_whole(spark, monkeypatch, most):
    """Each row once, with its nulls, in the partition of its part, however many are packed at a time."""
    monkeypatch.setattr(packed, "ROWS", most)
    rows = [(k, None if k % 5 == 0 else f"t{k % 3}", [float(k)] * (k % 4), None if k % 7 == 0 else k / 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, token string, list array<double>, x double").repartition(3)
    out = packed.dealt(df, F.col("id") % 4, 6)
    assert plan(out).count("Exchange") == plan(df).count("Exchange") + 1 and out.schema == df.schema and out.rdd.getNumPartitions() == 6
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    at = out.select((F.col("id") % 4).alias("part"), F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted(map(tuple, at)) == [(k, k) for k in range(4)]
    empty = packed.dealt(df.where("id < 0"), F.lit(0), 2)
    assert empty.count() == 0


def _kids(spark, n=40):
    rows = [(f"s{k}", f"f{k}", "", [], " ".join(f"w{(k * j) % 11} common" for j in range(1 + k % 6))) for k in range(n)] + [("none", "none", "", [], "the how")]
    return ranking.child_tokens(chunking.children(spark.createDataFrame(rows, "id string, file string, heading string, heading_path array<string>, content string")))


@pytest.mark.parametrize("broadcast", [500_000, 3])
def test_norms_are_found_where_a_childs_rows_meet(spark, monkeypatch, broadcast):
    """Also where rare tokens' weights are joined apart, and with many tasks; weights and norms are those of the rule."""
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ranking, "NORM_ROWS", 20)
    tokens = _kids(spark)
    got = ranking.vector_index(tokens)["postings"]
    assert "Window" not in plan(got) and "packed" in plan(got)
    texts = {r["id"]: r["tokens"] for r in tokens.collect()}
    df = {t: sum(t in x for x in texts.values()) for x in texts.values() for t in x}
    idf = {t: math.log((len(texts) + 1) / (n + 1)) + 1 for t, n in df.items()}
    weight = {i: {t: x.count(t) / max(map(x.count, x)) * idf[t] for t in set(x)} for i, x in texts.items()}
    want = {(i, t): (texts[i].count(t), w, math.sqrt(sum(y * y for y in weight[i].values()))) for i, x in weight.items() for t, w in x.items()}
    found = {(r["id"], r["token"]): (r["tf"], r["weight"], r["norm"]) for r in got.collect()}
    assert found.keys() == want.keys() and got.count() == len(want)
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-12) and a[2] == pytest.approx(b[2], abs=1e-12) for a, b in ((found[k], want[k]) for k in want))
    assert got.columns == ["id", "source_id", "token", "tf", "weight", "norm", "bucket"]


def test_stored_postings_are_sorted_in_their_folders(spark, tmp_path):
    rows = ranking.vector_index(_kids(spark))["postings"]
    index_store.write_table(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).select(rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    order = spark.read.parquet(str(tmp_path / "t")).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("n"), "token", "bucket", ranking.bucket().alias("own")).orderBy("f", "n").collect()
    assert all(a["f"] != b["f"] or a["token"] <= b["token"] for a, b in zip(order, order[1:])) and all(r["bucket"] == r["own"] for r in order)


def test_violations_are_summed_by_id_and_token(spark):
    """Nulls, repeated and lacking records, lacking tokens; no weight goes by token or id as a row."""
    w = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 2.0), ("c", "z", 1.0), ("c", "z2", 1.0)], "id string, token string, weight double")
    r = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 9.0), ("d", 0.0), ("e", 1.0), (None, 1.0), ("", None)], "id string, norm double")
    i = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "token string, idf double")
    out = identity.vector_violations(r, w, i)
    assert plan(out).count("LeftAnti") == 1  # tokens' sums with the vocabulary
    assert {x["check"]: x["n"] for x in out.collect()} == {"duplicate id": 1, "empty id": 2, "duplicate token": 0, "empty token": 0, "bad idf": 0, "bad weight": 0, "token outside vocabulary": 2, "weights without record": 2, "wrong norm": 3}
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "bigint"] and out.count() == 9
