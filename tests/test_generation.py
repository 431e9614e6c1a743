import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import generation, incremental
from quillspark.sources import cache_store


def _generator(folder, fail_first):
    """Notes each call in a file; the first call of each batch fails, if wanted."""

    def generate(prompts):
        name = "-".join(prompts).replace(" ", "_")
        tried = os.path.exists(f"{folder}/{name}.tried")
        open(f"{folder}/{name}.tried", "a").close()
        if fail_first and not tried:
            raise OSError("busy")
        with open(f"{folder}/{name}.done", "a") as f:
            f.write("x")
        return [f"answer to {p}" for p in prompts]

    return generate


def test_each_prompt_is_answered_once_though_each_batch_fails_once(spark, tmp_path):
    notes, log = tmp_path / "notes", str(tmp_path / "log")
    notes.mkdir()
    prompts = spark.createDataFrame([(k, f"prompt {k % 20}") for k in range(30)] + [(99, None)], "query_id long, prompt string")
    got = {r["query_id"]: (r["answer"], r["error"]) for r in generation.answered(prompts, _generator(notes, True), log, batch=3, pause=0.01, wave=7).collect()}
    assert got == {k: (f"answer to prompt {k % 20}", None) for k in range(30)} | {99: (None, None)}
    done = [f for f in os.listdir(notes) if f.endswith(".done")]
    assert sum(f.count("prompt") for f in done) == 20 and all((notes / f).read_text() == "x" for f in done)
    more = prompts.union(spark.createDataFrame([(100, "prompt 100")], "query_id long, prompt string"))
    assert generation.answered(more, _generator(notes, False), log).where("answer IS NULL").count() == 1
    assert len([f for f in os.listdir(notes) if f.endswith(".done")]) == len(done) + 1


def test_what_keeps_failing_is_logged_and_asked_for_again(spark, tmp_path):
    prompts, log = spark.createDataFrame([("a",), ("b",)], "prompt string"), str(tmp_path / "log")

    def fails(_):
        raise ValueError("no")

    rows = generation.answered(prompts, fails, log, tries=2, pause=0.01).collect()
    assert [(r["answer"], r["error"]) for r in rows] == [(None, "ValueError: no")] * 2
    assert {r["answer"] for r in generation.answered(prompts, lambda p: p, log).collect()} == {"a", "b"}
    assert {r["error"] for r in generation.answered(prompts, fails, log).collect()} == {None}


def _rows(spark, n, namespace="x"):
    rows = spark.createDataFrame([(f"c{k}", f"s{k}", f"h{k}", [0.6, 0.8]) for k in range(n)], "chunk_id string, source_id string, content_hash string, vector array<float>")
    return incremental.cache_rows(rows, namespace)


def test_a_refused_replacement_leaves_the_cache_as_it_was(spark, tmp_path):
    root = str(tmp_path)
    assert cache_store.read(spark, root, "x").count() == 0
    cache_store.replace(_rows(spark, 5), root, "x", 2)
    cache_store.replace(_rows(spark, 3, "y"), root, "y", 2)
    faults = {
        "checksum": _rows(spark, 4).withColumn("vector_sha256", F.lit("0")),
        "duplicate ids": _rows(spark, 4).union(_rows(spark, 1)),
        "wrong dimension": _rows(spark, 4).withColumn("vector", F.array(F.lit(1.0)).cast("array<float>")),
        "not finite": _rows(spark, 4).withColumn("vector", F.array(F.lit(float("nan")), F.lit(1.0)).cast("array<float>")),
        "other namespace": _rows(spark, 4, "z"),
    }
    for name, rows in faults.items():
        with pytest.raises(ValueError, match=name):
            cache_store.replace(rows, root, "x", 2)
    with pytest.raises(RuntimeError):
        cache_store.replace(_rows(spark, 4), root, "x", 2, activate=lambda: False)
    assert cache_store.read(spark, root, "x").count() == 5 and cache_store.read(spark, root, "y").count() == 3
    assert len([f for f in os.listdir(f"{root}/ns=x") if f.startswith("gen=")]) == 1  # what was staged is gone
    cache_store.replace(_rows(spark, 2), root, "x", 2)
    assert cache_store.read(spark, root, "x").count() == 2


def test_a_bucketed_cache_is_not_shuffled(spark):
    rows = _rows(spark, 50)
    incremental.store_bucketed(rows, "cache_of_test", 4)
    try:
        kids = spark.createDataFrame([(f"c{k}", f"h{k if k % 2 else 'new'}") for k in range(60)], "chunk_id string, content_hash string")
        for find, n in ((incremental.cache_hits, 25), (incremental.cache_misses, 35)):
            found = find(kids.hint("merge"), spark.table("cache_of_test"), "x", 2)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.count() == n and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.sql("DROP TABLE cache_of_test")
