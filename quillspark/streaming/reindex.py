"""Continuous re-indexing: new or replaced Markdown files arrive as a stream; each micro-batch is merged into a table of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import markdown
from quillspark.operators.incremental import fingerprints
from quillspark.sources import index_store, markdown_files, segments

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, directory: str) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.md").load(directory)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", "modificationTime")


def merge(root: str):
    """For foreachBatch: sections of the batch's files replace the former ones. A batch that runs again gives the same table."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("file").agg(F.max_by("content", "modificationTime").alias("content"))
        fresh = markdown.sections(markdown_files.texts(latest))
        before = index_store.current(spark, root)
        stored = index_store.load(spark, root)
        if set(stored) - {"sections"}:
            raise ValueError(f"{root} holds a whole index, whose other tables a table of sections would not follow; merge_segments() goes on with one")
        old = stored.get("sections")
        table = fresh if old is None else old.join(latest.select("file"), "file", "left_anti").select(fresh.columns).unionByName(fresh)
        index_store.save(spark, root, {"sections": table})
        # readers may still have the generation before; those before that go
        for gen in index_store.generations(spark, root):
            if gen not in (before, index_store.current(spark, root)):
                index_store.drop_generation(spark, root, gen)

    return run


def merge_segments(root: str, settings: dict | None = None):
    """For foreachBatch: a segment of each batch's files, with all that searches need; nothing of other files is read or written. A batch that runs again
    replaces its files by the same ones."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("file").agg(F.max_by(F.struct("content", "modificationTime"), "modificationTime").alias("f")).select("file", "f.*")
        files = fingerprints(latest.select(F.col("file").alias("path"), "content", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")))
        segments.update(spark, root, markdown.sections(markdown_files.texts(latest)), files, settings=settings)

    return run


def start(spark: SparkSession, directory: str, root: str, checkpoint: str, merge=merge):
    """Processes what is there and stops; run again, it goes on with files that came since. merge: merge or merge_segments."""
    return stream(spark, directory).writeStream.foreachBatch(merge(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
