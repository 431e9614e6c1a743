import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import incremental
from quillspark.plans import build
from quillspark.sources import index_store, markdown_files
from quillspark.streaming import reindex as streaming

FILES = "path string, size long, mtime_ns long, content_hash string"


def test_diff(spark):
    old = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 1, 1, "a"), ("edited", 1, 1, "a"), ("gone", 1, 1, "a")], FILES)
    new = spark.createDataFrame([("same", 1, 1, "a"), ("touched", 1, 2, "a"), ("edited", 2, 1, "b"), ("new", 1, 1, "a")], FILES)
    diff = incremental.index_diff(old, new)
    assert {r["path"]: r["status"] for r in diff.collect()} == {"same": "skipped", "touched": "changed", "edited": "changed", "gone": "deleted", "new": "changed"}
    assert incremental.run_stats(diff).first().asDict() == {"changed": 3, "skipped": 1, "deleted": 1}


def test_build_rerun_edit_delete(spark, tmp_path):
    docs, root = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    (docs / "a b.md").write_text("# T\n## One\nalpha\n")
    (docs / "b.md").write_text("## Two\nbeta\n")
    (docs / "c.txt").write_text("## Not\nread\n")
    assert build.reindex(spark, str(docs), root) == {"changed": 2, "skipped": 0, "deleted": 0}
    first = index_store.current(spark, root)
    assert build.reindex(spark, str(docs), root) == {"changed": 0, "skipped": 2, "deleted": 0}
    assert index_store.current(spark, root) == first
    (docs / "b.md").write_text("## Two\ngamma\n")
    assert build.reindex(spark, str(docs), root) == {"changed": 1, "skipped": 1, "deleted": 0}
    got = {r["id"]: r["content"] for r in index_store.load(spark, root)["sections"].collect()}
    assert got == {"a b.md#one": "alpha", "b.md#two": "gamma"}
    os.remove(docs / "a b.md")
    assert build.reindex(spark, str(docs), root)["deleted"] == 1
    assert [r["id"] for r in index_store.load(spark, root)["sections"].collect()] == ["b.md#two"]


def test_bad_utf8_is_an_error(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"## A\n\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        markdown_files.texts(markdown_files.scan(spark, str(tmp_path))).collect()


def test_store_keeps_the_old_generation_when_refused_or_damaged(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame([(1, "a")], "k int, v string")
    gen = index_store.save(spark, root, {"t": df})
    with pytest.raises(RuntimeError):
        index_store.save(spark, root, {"t": df}, activate=lambda m: False)
    assert index_store.current(spark, root) == gen
    spark.createDataFrame([(2, "b")], "k int, v string").write.mode("overwrite").parquet(f"{root}/gen={gen}/t")
    with pytest.raises(ValueError):
        index_store.verify(spark, root, gen)
    with pytest.raises(ValueError):
        index_store.drop_generation(spark, root, gen)


def cache(spark):
    v = spark.createDataFrame([(str(k), "p", f"h{k}", [float(k), 1.0]) for k in range(5)], "chunk_id string, source_id string, content_hash string, vector array<float>")
    return v, incremental.cache_rows(v, "ns")


def test_cache_hits_misses_and_violations(spark):
    v, rows = cache(spark)
    kids = v.withColumn("content_hash", F.when(F.col("chunk_id") == "0", "new").otherwise(F.col("content_hash"))).drop("vector")
    bad = rows.withColumn("vector_sha256", F.when(F.col("chunk_id") == "1", F.lit(None)).otherwise(F.col("vector_sha256"))).withColumn("dimension", F.when(F.col("chunk_id") == "2", 3).otherwise(F.col("dimension"))).withColumn("vector", F.when(F.col("chunk_id") == "3", F.array(F.lit(float("nan")), F.lit(1.0)).cast("array<float>")).otherwise(F.col("vector")))
    assert [r["chunk_id"] for r in incremental.cache_hits(kids, bad, "ns", 2).collect()] == ["4"]
    assert sorted(r["chunk_id"] for r in incremental.cache_misses(kids, bad, "ns", 2).collect()) == ["0", "1", "2", "3"]
    assert incremental.cache_hits(kids, rows, "other", 2).count() == 0
    assert {r["check"]: r["n"] for r in incremental.cache_violations(bad.union(bad.where("chunk_id = '4'")), 2).collect()} == {"duplicate ids": 1, "wrong dimension": 0, "not finite": 1, "checksum": 2}


def test_only_misses_are_embedded(spark):
    v, rows = cache(spark)
    kids = v.drop("vector").withColumn("embedding_text", F.lit("t")).withColumn("content_hash", F.when(F.col("chunk_id") == "0", "new").otherwise(F.col("content_hash")))
    got = incremental.embed_missing(kids, rows, "ns", 2, lambda texts: [[9.0, 9.0] for _ in texts]).collect()
    assert {r["chunk_id"]: r["vector"] for r in got} == {"0": [9.0, 9.0]} | {str(k): [float(k), 1.0] for k in range(1, 5)}
    with pytest.raises(Exception, match="dimension"):
        incremental.embed_missing(kids, rows, "ns", 2, lambda texts: [[9.0] for _ in texts]).collect()


def test_cache_replace(spark):
    _, rows = cache(spark)
    other = rows.withColumn("namespace_fingerprint", F.lit("other"))
    got = incremental.cache_replace(rows.union(other), "ns", rows.where("chunk_id = '0'"))
    assert sorted((r[0], r[1]) for r in got.select("namespace_fingerprint", "chunk_id").collect()) == [("ns", "0")] + [("other", str(k)) for k in range(5)]


def test_child_violations(spark):
    df = spark.range(1).select(F.lit("c").alias("chunk_id"), F.lit("s").alias("source_id"), F.lit("../f.md").alias("file"), F.lit("t").alias("embedding_text"), F.lit("nohash").alias("content_hash"))
    assert {r["check"]: r["n"] for r in incremental.child_violations(df.union(df)).collect()} == {"empty id": 0, "long id": 0, "hash form": 2, "hash value": 2, "unsafe path": 2, "duplicate id": 1}


def test_stream_merges_new_files(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    run = lambda: streaming.start(spark, str(docs), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    (docs / "a.md").write_text("## One\nalpha\n")
    run()
    (docs / "b.md").write_text("## Two\nbeta\n")
    run()
    (docs / "c.md").write_text("## Three\ngamma\n")
    run()
    assert len(index_store.generations(spark, str(tmp_path / "index"))) == 2
    got = index_store.load(spark, str(tmp_path / "index"))["sections"]
    assert sorted(r["id"] for r in got.collect()) == ["a.md#one", "b.md#two", "c.md#three"]


def test_pointers_are_only_ever_added(spark, tmp_path):
    root, df = str(tmp_path), spark.createDataFrame([(1, "a")], "k int, v string")
    gens = [index_store.save(spark, root, {"t": df}) for _ in range(3)]
    assert index_store.current(spark, root) == gens[-1] and len(index_store._pointers(spark, root)) == 3
    (tmp_path / "current" / f"{4:020d}").write_text(gens[0])
    assert index_store.current(spark, root) == gens[0]


def test_other_settings_are_indexed_anew_and_changes_meanwhile_refused(spark, tmp_path, monkeypatch):
    docs, root = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    (docs / "a.md").write_text("## One\nalpha\n")
    assert build.reindex(spark, str(docs), root)["changed"] == 1
    monkeypatch.setattr(build, "settings", lambda: {"policy": "another"})
    assert build.reindex(spark, str(docs), root) == {"changed": 1, "skipped": 0, "deleted": 0}
    before, real = index_store.current(spark, root), markdown_files.scan
    (docs / "b.md").write_text("## Two\nbeta\n")
    calls = []

    def scan(*x):
        if calls:
            (docs / "b.md").write_text("## Two\nbeta and more\n")
        calls.append(1)
        return real(*x)

    monkeypatch.setattr(markdown_files, "scan", scan)
    with pytest.raises(RuntimeError):
        build.reindex(spark, str(docs), root)
    assert index_store.current(spark, root) == before and not [p for p in os.listdir(root) if p.startswith("taken")]


def test_cache_sink_replaces_namespaces_alone(spark, tmp_path):
    v, rows = cache(spark)
    path = str(tmp_path / "cache")
    incremental.write_cache(rows.union(rows.withColumn("namespace_fingerprint", F.lit("other"))), path)
    incremental.write_cache(rows.where("chunk_id = '0'"), path)
    assert {r[0]: r[1] for r in spark.read.parquet(path).groupBy("namespace_fingerprint").count().collect()} == {"ns": 1, "other": 5}


@pytest.mark.parametrize("value", [float("nan"), float("inf")])
def test_vectors_from_a_provider_must_be_finite(spark, value):
    v, rows = cache(spark)
    kids = v.drop("vector").withColumn("embedding_text", F.lit("t")).withColumn("content_hash", F.lit("new"))
    with pytest.raises(Exception, match="finite"):
        incremental.embed_missing(kids, rows, "ns", 2, lambda texts: [[value, 1.0] for _ in texts]).collect()
