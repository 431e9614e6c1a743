"""Snapshots of a directory as a log of changes, and the index that follows the log as a stream: deleted files are seen, and a changed file costs its own sections.

    <log>/changes/n=<number>/   what differs from the snapshot before: files with their contents, and files that are gone
    <log>/files/n=<number>/     the files known at a number, written each KEEP captures; those since are folded in from the changes

capture() compares files with what the log knows, as one full outer join, and appends the difference whole, by one rename. The log's folder is a file stream, so Structured
Streaming's own checkpoint says how far an index has come; several indexes may follow one log. A batch that runs again replaces its files by the same
ones, and a file that changes several times within a batch counts as it was last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import incremental, markdown, ranking
from quillspark.sources import index_store, markdown_files, segments

#: Captures after which the known files are written anew.
KEEP = 16
KNOWN = "path string, size long, mtime_ns long, content_hash string"
CHANGES = f"{KNOWN}, deleted boolean, content binary"
NAMES = [c.split()[0] for c in KNOWN.split(", ")]


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    _, fs, p = index_store._fs(spark, folder)
    found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x[2:]) for x in found if x.startswith("n=") and x[2:].isdigit())


def _move(spark: SparkSession, staged: str, place: str) -> bool:
    """A folder to its place, unless there is one."""
    jvm, fs, p = index_store._fs(spark, place)
    fs.mkdirs(p.getParent())
    return not fs.exists(p) and fs.rename(jvm.org.apache.hadoop.fs.Path(staged), p)


def _drop(spark: SparkSession, folder: str) -> None:
    _, fs, p = index_store._fs(spark, folder)
    fs.delete(p, True)


def known(spark: SparkSession, log: str, upto: int | None = None) -> DataFrame:
    """(path, size, mtime_ns, content_hash) of the files there were at a number, the last by default."""
    numbers = [n for n in _numbers(spark, f"{log}/changes") if upto is None or n <= upto]
    whole = [n for n in _numbers(spark, f"{log}/files") if numbers and n <= numbers[-1]]
    start = whole[-1] if whole else 0
    rows = spark.read.schema(KNOWN).parquet(f"{log}/files/n={start}") if whole else segments._empty(spark, "files")
    later = [f"{log}/changes/n={n}" for n in numbers if n > start]
    if not later:
        return rows
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/n=(\d+)/[^/]*$", 1).cast("long")
    since = spark.read.schema(CHANGES).parquet(*later).select(*NAMES, "deleted", number.alias("n"))
    both = rows.select("*", F.lit(False).alias("deleted"), F.lit(start).cast("long").alias("n")).unionByName(since)
    last = both.groupBy("path").agg(F.max_by(F.struct(*NAMES[1:], "deleted"), "n").alias("f"))
    return last.where("NOT f.deleted").select("path", *[F.col(f"f.{c}") for c in NAMES[1:]])


def _changed(files: DataFrame, diff: DataFrame, stats: dict[str, int]) -> DataFrame:
    """Files that diff calls changed, by a join with those or with the others, whichever are fewer: no content is shuffled for a few paths, nor for a first snapshot."""
    if stats["changed"] <= stats["skipped"] + stats["deleted"]:
        return files.join(ranking.small(diff.where("status = 'changed'").select("path")), "path", "left_semi")
    return files.join(ranking.small(diff.where("status <> 'changed'").select("path")), "path", "left_anti")


def _latest(batch: DataFrame) -> DataFrame:
    """Rows of a batch without those of a path that it has again with a greater number. Only paths that it has several times are joined."""
    again = batch.groupBy("path").agg(F.max("n").alias("last"), F.count("*").alias("times")).where("times > 1").select("path", "last")
    return batch.join(ranking.small(again), "path", "left").where("last IS NULL OR n = last").drop("last")


def capture(files: DataFrame, log: str) -> dict[str, int]:
    """Append how files (path, content, mtime_ns) differ from what the log knows; returns the counts of changed, skipped and deleted. Nothing is written where nothing differs.

    A file without a path is no file, one beyond MAX_FILE_BYTES counts as not there, a null content as empty; two rows of one path are an error. A file is logged as
    it is read the second time, for its content: should it change or go between the two readings, the next capture sees what is left to see.
    """
    spark = files.sparkSession
    files = files.select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"), "mtime_ns").where("path IS NOT NULL")
    numbers = _numbers(spark, f"{log}/changes")
    number, staged = (numbers[-1] if numbers else 0) + 1, f"{log}/staged-{uuid.uuid4().hex}"
    try:
        now = incremental.fingerprints(files)
        incremental.index_diff(known(spark, log), now).write.parquet(f"{staged}/diff")
        diff = spark.read.schema("path string, status string").parquet(f"{staged}/diff")
        if not diff.groupBy("path").count().where("count > 1").isEmpty():
            raise ValueError("some path has several files")
        stats = incremental.run_stats(diff).first().asDict()
        if not stats["changed"] and not stats["deleted"]:
            return stats
        size = F.octet_length("content").cast("long")
        changed = _changed(files, diff, stats).where(size <= incremental.MAX_FILE_BYTES)
        changed = changed.select("path", size.alias("size"), "mtime_ns", F.sha2("content", 256).alias("content_hash"), F.lit(False).alias("deleted"), "content")
        gone = diff.where("status = 'deleted'").select("path", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CHANGES.split(", ")[1:4])], F.lit(True).alias("deleted"), F.lit(None).cast("binary").alias("content"))
        changed.unionByName(gone).write.parquet(f"{staged}/changes", compression=index_store.CODEC)
        if not _move(spark, f"{staged}/changes", f"{log}/changes/n={number}"):
            raise segments.Conflict(f"change {number} was logged by another writer")
        if number % KEEP == 0:
            known(spark, log, number).write.parquet(f"{staged}/files")
            _move(spark, f"{staged}/files", f"{log}/files/n={number}")  # it is there already if another was first, and the same
        return stats
    finally:
        _drop(spark, staged)


def stream(spark: SparkSession, log: str) -> DataFrame:
    """(path, size, mtime_ns, content_hash, deleted, content, n) as they are logged."""
    _, fs, p = index_store._fs(spark, f"{log}/changes")
    fs.mkdirs(p)
    return spark.readStream.schema(f"{CHANGES}, n long").parquet(f"{log}/changes")


def parsed(files: DataFrame) -> DataFrame:
    """Sections of Markdown files (path, content)."""
    return markdown.sections(markdown_files.texts(files.withColumnRenamed("path", "file")))


def merge(root: str, settings: dict | None = None, parse=parsed, spark: SparkSession | None = None):
    """For foreachBatch over stream(): one segment of each batch, which replaces its changed files and takes its deleted ones away.

    What the batch comes to is written once and goes on in spark, by default the stream's own session, which plans without adaptive execution.
    """

    def run(batch: DataFrame, _: int) -> None:
        session, taken = spark or batch.sparkSession, f"{root}/making-{uuid.uuid4().hex}"
        _latest(batch).select([c.split()[0] for c in CHANGES.split(", ")]).write.parquet(taken, compression=index_store.CODEC)
        latest = session.read.schema(CHANGES).parquet(taken)
        there = latest.where("NOT deleted")
        try:
            segments.update(session, root, parse(there.select("path", "content")), there.select(NAMES), latest.where("deleted").select("path"), settings)
        finally:
            _drop(session, taken)

    return run


def start(spark: SparkSession, log: str, root: str, checkpoint: str, settings: dict | None = None, parse=parsed):
    """Brings the index up to the log and stops; run again, it goes on with what was logged since."""
    return stream(spark, log).writeStream.foreachBatch(merge(root, settings, parse, spark)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, directory: str, log: str, root: str, checkpoint: str) -> dict[str, int]:
    """A snapshot of the Markdown directory, and the index brought up to it; returns the snapshot's counts."""
    stats = capture(markdown_files.scan(spark, directory), log)
    start(spark, log, root, checkpoint).awaitTermination()
    return stats
