"""Nearest vectors from balls against all products, and how many products they save."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import balls, ranking

SCHEMA = "id long, vector array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def results(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def asked(vectors):
    return vectors.where("id % 10 = 0 AND vector IS NOT NULL").select(F.col("id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def clustered(spark):
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 16))
    rows = [(i, centres[i % 12 if i % 3 else 0] + 0.05 * pick.normal(size=16)) for i in range(1200)]  # a third and more in one cluster
    return table(spark, rows)


def test_clusters_are_left_out(spark, tmp_path, clustered):
    balls.build(spark, str(tmp_path / "b"), clustered, 24)
    index = balls.Balls(spark, str(tmp_path / "b"))
    assert results(index.search(asked(clustered), 5)) == results(ranking.dense_topk(clustered, asked(clustered), 5))
    assert 0 < index.share < 0.5


def test_even_directions_ties_and_odd_vectors(spark, tmp_path):
    pick = np.random.default_rng(4)
    rows = [(i, pick.normal(size=8)) for i in range(300)]
    rows += [(1000 + i, [1, 0, 0, 0, 0, 0, 0, 0]) for i in range(30)] + [(2000, None), (2001, [0] * 8), (2010, [0] * 8)]  # equal ones, null, zero
    vectors = table(spark, rows)
    balls.build(spark, str(tmp_path / "b"), vectors, 16)
    index = balls.Balls(spark, str(tmp_path / "b"))
    want = results(ranking.dense_topk(vectors, asked(vectors), 7))
    assert results(index.search(asked(vectors), 7)) == want and want
    # more results than there are, and a query of another width
    few = table(spark, rows[:3])
    balls.build(spark, str(tmp_path / "few"), few)
    assert results(balls.Balls(spark, str(tmp_path / "few")).search(asked(vectors), 7)) == results(ranking.dense_topk(few, asked(vectors), 7))
    with pytest.raises(ValueError, match="dimensions"):
        index.search(table(spark, [(1, [1, 2])]).withColumnRenamed("id", "query_id"), 3)


def test_nothing_to_search(spark, tmp_path):
    balls.build(spark, str(tmp_path / "b"), table(spark, [(1, None)]))
    one = table(spark, [(1, [1, 2])])
    assert balls.Balls(spark, str(tmp_path / "b")).search(asked(one), 3).count() == 0
    assert balls.Balls(spark, str(tmp_path / "b")).search(one.withColumnRenamed("id", "query_id"), 3).count() == 0


def test_queries_in_blocks(spark, tmp_path, clustered, monkeypatch):
    balls.build(spark, str(tmp_path / "b"), clustered, 24)
    want = results(ranking.dense_topk(clustered, asked(clustered), 3))
    monkeypatch.setattr(ranking, "MATRIX_BYTES", 40 * 16 * 8)
    assert results(balls.Balls(spark, str(tmp_path / "b")).search(asked(clustered), 3)) == want
