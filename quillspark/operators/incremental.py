"""Incremental indexing: snapshot differences, upserts, the vector cache, and checks of stored records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The greatest Markdown file and id, in bytes.
MAX_FILE_BYTES, MAX_ID_BYTES = 10 * 1024 * 1024, 8192
#: Fixed value: how vectors are said to be stored.
VECTOR_ENCODING = "float32-le-v1"


def fingerprints(files: DataFrame) -> DataFrame:
    """files (path, content binary or text, mtime_ns) -> (path, size, mtime_ns, content_hash) of those within MAX_FILE_BYTES."""
    content = F.col("content").cast("binary")
    return files.select("path", F.octet_length(content).cast("long").alias("size"), "mtime_ns", F.sha2(content, 256).alias("content_hash")).where(F.col("size") <= MAX_FILE_BYTES)


def index_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, status): changed (new, or size, time or hash differ), skipped or deleted."""
    k, s = (df.select("path", F.struct("size", "mtime_ns", "content_hash").alias(name)) for df, name in ((known, "was"), (seen, "now")))
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "skipped").otherwise("changed")
    return k.join(s, "path", "full_outer").select("path", status.alias("status"))


def run_stats(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("changed", "skipped", "deleted")])


def upsert(old: DataFrame, new: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the next generation: old rows of skipped files, and new rows of changed ones."""
    keep = old.join(diff.where("status = 'skipped'").select(F.col("path").alias(key)), key, "left_semi")
    return keep.unionByName(new.join(diff.where("status = 'changed'").select(F.col("path").alias(key)), key, "left_semi"))


def usable(dimension: int):
    """Whether a cached vector row may be used; a null anywhere is a miss."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.col("vector_encoding") == VECTOR_ENCODING) & (F.col("dimension") == dimension) & (F.size(v) == dimension) & finite & (F.sha2(F.to_json(v), 256) == F.col("vector_sha256")), F.lit(False))


def cache_rows(vectors: DataFrame, namespace: str) -> DataFrame:
    """vectors (chunk_id, source_id, content_hash, vector) as cache rows."""
    return vectors.select(F.lit(namespace).alias("namespace_fingerprint"), "chunk_id", "source_id", "content_hash", F.size("vector").alias("dimension"), F.lit(VECTOR_ENCODING).alias("vector_encoding"), "vector", F.sha2(F.to_json("vector"), 256).alias("vector_sha256"))


def cache_hits(children: DataFrame, cache: DataFrame, namespace: str, dimension: int) -> DataFrame:
    """Children (chunk_id, content_hash) with the cached vector, where a usable one is."""
    rows = cache.where((F.col("namespace_fingerprint") == namespace) & usable(dimension)).select("chunk_id", "content_hash", "vector")
    return children.join(rows, ["chunk_id", "content_hash"])


def cache_misses(children: DataFrame, cache: DataFrame, namespace: str, dimension: int) -> DataFrame:
    rows = cache.where((F.col("namespace_fingerprint") == namespace) & usable(dimension)).select("chunk_id", "content_hash")
    return children.join(rows, ["chunk_id", "content_hash"], "left_anti")


def cache_replace(cache: DataFrame, namespace: str, rows: DataFrame) -> DataFrame:
    """The cache with a namespace's rows replaced; written by partition overwrite of namespace_fingerprint."""
    return cache.where(F.col("namespace_fingerprint") != namespace).unionByName(rows)


def write_cache(rows: DataFrame, path: str) -> None:
    """Replace the namespaces that rows have in a cache of one folder per namespace; the others' folders are left alone."""
    rows.write.mode("overwrite").partitionBy("namespace_fingerprint").option("partitionOverwriteMode", "dynamic").parquet(path)


def store_bucketed(rows: DataFrame, table: str, buckets: int = 256) -> None:
    """Cache rows as a catalog table bucketed and sorted by what cache_hits() and cache_misses() join on, so that they shuffle the children and never the cache."""
    rows.repartition(buckets, "chunk_id", "content_hash").write.mode("overwrite").bucketBy(buckets, "chunk_id", "content_hash").sortBy("chunk_id", "content_hash").saveAsTable(table)


def cache_violations(rows: DataFrame, dimension: int) -> DataFrame:
    """(check, n): what must be zero before rows are written."""
    twice = rows.groupBy("namespace_fingerprint", "chunk_id").count().where("count > 1")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    checks = [("duplicate ids", twice), ("wrong dimension", rows.where((F.size("vector") != dimension) | F.col("vector").isNull())), ("not finite", rows.where(~F.coalesce(finite, F.lit(False)))), ("checksum", rows.where(~(F.sha2(F.to_json("vector"), 256).eqNullSafe(F.col("vector_sha256")))))]
    out = None
    for name, df in checks:
        one = df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def embed_missing(children: DataFrame, cache: DataFrame, namespace: str, dimension: int, embed, batch: int = 64) -> DataFrame:
    """Cache rows of all children: hits as they are, misses embedded in batches by embed(list of texts) -> list of vectors."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = embed(part.column("embedding_text").to_pylist())
                if len(got) != part.num_rows or any(len(v) != dimension or not all(map(math.isfinite, v)) for v in got):
                    raise ValueError("the provider must give one vector of the dimension per text, of finite numbers")
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("chunk_id", "source_id", "content_hash")] + [pa.array(got, pa.list_(pa.float32()))], names=["chunk_id", "source_id", "content_hash", "vector"])

    fresh = cache_misses(children, cache, namespace, dimension).select("chunk_id", "source_id", "content_hash", "embedding_text").mapInArrow(run, "chunk_id string, source_id string, content_hash string, vector array<float>")
    hits = cache_hits(children, cache, namespace, dimension).select("chunk_id", "source_id", "content_hash", "vector")
    return cache_rows(hits.unionByName(fresh), namespace)


def child_violations(children: DataFrame) -> DataFrame:
    """(check, n) over child records: ids present, within MAX_ID_BYTES and unique; hashes hex and right; paths relative and safe."""
    bad = {
        "empty id": (F.coalesce(F.col("chunk_id"), F.lit("")) == "") | (F.coalesce(F.col("source_id"), F.lit("")) == ""),
        "long id": F.octet_length("chunk_id") > MAX_ID_BYTES,
        "hash form": ~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "hash value": ~F.col("content_hash").eqNullSafe(F.sha2("embedding_text", 256)),
        "unsafe path": F.col("file").rlike(r"^/|(^|/)\.\.(/|$)|\\"),
    }
    counts = children.agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    twice = children.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("duplicate id"))
    return counts.crossJoin(twice).unpivot([], [*bad, "duplicate id"], "check", "n")


def compare_indexes(expected: DataFrame, actual: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """(missing, unexpected, different) rows of two tables of key and number."""
    e, a = expected.select(key, F.col(value).alias("e")), actual.select(key, F.col(value).alias("a"))
    return e.join(a, key, "full_outer").agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.abs(F.col("e") - F.col("a")) > tolerance).alias("different"))


def manifest(children: DataFrame) -> DataFrame:
    return children.agg(F.count("*").alias("n_chunks"), F.countDistinct("source_id").alias("n_sections"), F.countDistinct("file").alias("n_files"))
