"""Markdown directories as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.incremental import MAX_FILE_BYTES, fingerprints


def scan(spark: SparkSession, directory: str) -> DataFrame:
    """(file, path, content, size, mtime_ns) of *.md right in the directory, up to MAX_FILE_BYTES; times are to the microsecond."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "false").load(directory)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return raw.where(F.col("length") <= MAX_FILE_BYTES).select(name.alias("file"), name.alias("path"), "content", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def texts(files: DataFrame) -> DataFrame:
    """(file, text); bytes that aren't UTF-8 are an error."""
    return files.select("file", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("file")))).alias("text"))


def snapshot(files: DataFrame) -> DataFrame:
    return fingerprints(files)
