"""The log of directory snapshots and the index that follows it: changes, deletions, restarts, several writers."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import incremental
from quillspark.sources import segments
from quillspark.streaming import changes


def files(spark, texts, mtime=1):
    return spark.createDataFrame([(p, t if t is None else bytearray(t.encode()), mtime) for p, t in texts.items()], "path string, content binary, mtime_ns long")


def paths(df):
    return sorted(r["path"] for r in df.collect())


def put(folder, texts):
    for name, text in texts.items():
        (folder / name).write_text(text)


def live(spark, root):
    return sorted(r["id"] for r in segments.Segments(spark, root).live("sections").collect())


def test_index_follows_a_directory(spark, tmp_path):
    docs, log, root, check = tmp_path / "docs", str(tmp_path / "log"), str(tmp_path / "index"), str(tmp_path / "check")
    docs.mkdir()
    put(docs, {"a.md": "# A\n\n## One\n\nfirst\n\n## Two\n\nsecond\n", "b.md": "# B\n\n## Three\n\nthird\n", "c.md": "# C\n\n## Four\n\nfourth\n"})
    assert changes.follow(spark, str(docs), log, root, check) == {"changed": 3, "skipped": 0, "deleted": 0}
    whole = live(spark, root)
    assert [x.split("#")[0] for x in whole] == ["a.md", "a.md", "b.md", "c.md"]
    assert changes.follow(spark, str(docs), log, root, check) == {"changed": 0, "skipped": 3, "deleted": 0}
    assert len(segments.Segments(spark, root).names) == 1  # nothing was logged

    os.remove(docs / "b.md")
    put(docs, {"a.md": "# A\n\n## Two\n\nother\n", "d.md": "# D\n\n## Five\n\nfifth\n"})
    assert changes.follow(spark, str(docs), log, root, check) == {"changed": 2, "skipped": 1, "deleted": 1}
    index = segments.Segments(spark, root)
    assert [x.split("#")[0] for x in live(spark, root)] == ["a.md", "c.md", "d.md"]
    newest = index.names[-1]
    assert sorted({r["file"] for r in index.raw("sections", [newest]).collect()}) == ["a.md", "d.md"]  # of what changed only
    assert index.stats().first()["n_files"] == 3


def test_several_captures_in_one_batch(spark, tmp_path):
    log, root, check = (str(tmp_path / x) for x in ("log", "index", "check"))
    text = lambda w: f"# T\n\n## {w}\n\n{w}\n"
    changes.capture(files(spark, {"a": text("old"), "b": text("kept"), "c": text("gone")}), log)
    changes.capture(files(spark, {"a": text("newer"), "b": text("kept"), "c": text("gone")}), log)
    changes.capture(files(spark, {"a": text("last"), "b": text("kept")}), log)
    changes.start(spark, log, root, check).awaitTermination()
    assert live(spark, root) == ["a#last", "b#kept"]
    # an index that begins later, or again from nothing, comes to the same; and so does a batch that runs twice
    other = str(tmp_path / "other")
    changes.start(spark, log, other, str(tmp_path / "other-check")).awaitTermination()
    batch = spark.read.schema(f"{changes.CHANGES}, n long").parquet(f"{log}/changes")
    changes.merge(other)(batch, 0)
    assert live(spark, other) == ["a#last", "b#kept"]


def test_known_files_fold_from_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "KEEP", 2)
    log, states = str(tmp_path / "log"), [{"a": "1", "b": "1"}, {"a": "2", "b": "1"}, {"b": "1", "c": "1"}, {"a": "3", "c": "1"}, {}]
    for texts in states:
        changes.capture(files(spark, texts), log)
    for n, texts in enumerate(states, 1):
        want = {(r["path"], r["content_hash"]) for r in incremental.fingerprints(files(spark, texts)).collect()}
        assert {(r["path"], r["content_hash"]) for r in changes.known(spark, log, n).collect()} == want
    assert changes._numbers(spark, f"{log}/files") == [2, 4] and paths(changes.known(spark, log)) == []


def test_odd_files(spark, tmp_path):
    log = str(tmp_path / "log")
    assert changes.capture(files(spark, {}), log) == {"changed": 0, "skipped": 0, "deleted": 0} and changes._numbers(spark, f"{log}/changes") == []
    assert changes.capture(files(spark, {"a": None, None: "x", "b": "", "big": "x" * (incremental.MAX_FILE_BYTES + 1)}), log)["changed"] == 2
    assert paths(changes.known(spark, log)) == ["a", "b"]
    twice = files(spark, {"c": "1"}).unionByName(files(spark, {"c": "2"}))
    with pytest.raises(ValueError, match="several files"):
        changes.capture(twice, log)
    assert changes._numbers(spark, f"{log}/changes") == [1] and not [x for x in os.listdir(log) if x.startswith("staged")]


def test_a_second_writer_of_a_number_is_refused(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    changes.capture(files(spark, {"a": "1"}), log)
    real = changes._numbers
    monkeypatch.setattr(changes, "_numbers", lambda s, f: [])  # listed before the other's change was there
    with pytest.raises(segments.Conflict):
        changes.capture(files(spark, {"b": "1"}), log)
    monkeypatch.setattr(changes, "_numbers", real)
    assert paths(changes.known(spark, log)) == ["a"]


def test_contents_are_not_shuffled_to_be_logged_or_taken(spark, tmp_path):
    """Whether nearly all files have changed or few: what is joined is the fewer paths."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([(f"f{k}", f"text {k}".encode(), 0) for k in range(9)], "path string, content binary, mtime_ns long")
    status = lambda few, other: spark.createDataFrame([(f"f{k}", few if k in (2, 5) else other) for k in range(9)] + [("gone", "deleted")], "path string, status string")
    for diff, stats, want in ((status("changed", "skipped"), {"changed": 2, "skipped": 7, "deleted": 1}, {"f2", "f5"}), (status("skipped", "changed"), {"changed": 7, "skipped": 2, "deleted": 1}, {f"f{k}" for k in range(9)} - {"f2", "f5"})):
        df = changes._changed(files, diff, stats)
        assert "hashpartitioning" not in plan(df) and {r["path"] for r in df.collect()} == want
    batch = files.select("*", F.lit(1).alias("n")).union(files.where("path IN ('f3', 'f4')").select("*", F.lit(2).alias("n"))).union(files.where("path = 'f4'").select("*", F.lit(3).alias("n")))
    df = changes._latest(batch)
    assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    assert sorted((r["path"], r["n"]) for r in df.collect()) == sorted((f"f{k}", {3: 2, 4: 3}.get(k, 1)) for k in range(9))
