"""The vector cache on disk: each namespace is replaced as a whole, or not at all.

Two phases. First the rows are staged as a generation of their own: Spark's writer commits files whole, their digests get one root, and they are
read back and checked. Then, if the checks find nothing and activate() still allows it, one new pointer makes them the namespace. Until that pointer
is there, and for good where a check fails, readers find the rows of before; other namespaces are never touched.

Rows lie sorted by key within their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import incremental
from quillspark.sources import index_store

FIELDS = "namespace_fingerprint string, chunk_id string, source_id string, content_hash string, dimension int, vector_encoding string, vector array<float>, vector_sha256 string"


def _folder(root: str, namespace: str) -> str:
    return f"{root}/ns={namespace}"


def replace(rows: DataFrame, root: str, namespace: str, dimension: int, activate=lambda: True) -> str:
    """Make rows the cache of a namespace, if cache_violations() finds nothing in what was staged and activate() allows it; ValueError or RuntimeError otherwise."""
    spark = rows.sparkSession
    staged = rows.select([F.col(n).cast(t).alias(n) for n, t in (f.split() for f in FIELDS.split(", "))])
    base = _folder(root, namespace)

    def good(manifest) -> bool:
        table = index_store.load(spark, base, manifest["generation"])["rows"]
        bad = {r["check"]: r["n"] for r in incremental.cache_violations(table, dimension).collect() if r["n"]}
        if n := table.where(~F.col("namespace_fingerprint").eqNullSafe(F.lit(namespace))).count():
            bad["other namespace"] = n
        if bad:
            raise ValueError("the rows can't be cached: " + ", ".join(f"{n} {check}" for check, n in sorted(bad.items())))
        return activate()

    before = set(index_store.generations(spark, base))
    try:
        return index_store.save(spark, base, {"rows": staged.repartition("chunk_id").sortWithinPartitions("chunk_id", "content_hash")}, {"dimension": dimension}, activate=good)
    except Exception:
        for gen in set(index_store.generations(spark, base)) - before:  # what was staged and isn't current
            if gen != index_store.current(spark, base):
                index_store.drop_generation(spark, base, gen)
        raise


def read(spark: SparkSession, root: str, namespace: str) -> DataFrame:
    """The rows of a namespace, none if it isn't there. Files are held against their digests."""
    found = index_store.load(spark, _folder(root, namespace))
    return found["rows"] if found else spark.createDataFrame([], FIELDS)
