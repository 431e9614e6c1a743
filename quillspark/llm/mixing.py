"""Mixing sources to target weights (op 9) by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document has a key -ln(u) / w: u is uniform from a digest of its id and a seed, w its quality weight. Within a source the
documents of least keys are a weighted sample without replacement. A source whose target is above its size gets whole epochs first;
what remains is taken in key order up to the budget, by prefix sums of words. The document across the budget is
taken if its middle lies within, so the words taken are off by half that document at most.

Prefix sums go by BUCKETS ranges of the key within each source, then by rows within a bucket: a source with a third of all rows
is spread over its buckets, and none is sorted in one task. Rows of one id (or of none) have one key and so one bucket. A bucket of
over CROWDED times its share, and of CELL_ROWS rows, is summed by distinct (key, id, size) first; equal rows are numbered in parts of about CELL_ROWS.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share SHARE of all words; a target stops at CAP
times its source's words and the excess is shared anew by weight until none is above (solved in closed form over one row per source).

Defined results: a null or empty text has size 0, so no words are taken of it, and it has CAP copies at most like any other; a very long
text is one document, taken whole or not; a null source is a source; of equal keys the least id and size go first; repeated rows
are documents of their own (equal rows are interchangeable); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, table, written

WEIGHTS, SHARE, CAP, BUCKETS, SEED = (3, 1, 2), 1.5, 2, 4096, "mix-1"
#: Times its share of a source's rows, and rows, beyond which a bucket goes by distinct rows; rows of a part of equal ones, about.
CROWDED, CELL_ROWS = 8, 100_000
#: Tasks in which a group of equal rows meets its sums.
SALTS = 64
#: Characters that lower a document's quality weight.
SYMBOLS = "[#*$%&|<>]+"


def n_words(text="text"):
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), WORD_SPLIT), "")), F.lit(0)).cast("long")


def quality_weight(text="text"):
    """1 for plain prose, less the more symbols it has."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    symbols = n - F.length(F.regexp_replace(t, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols.cast("double") / F.greatest(n, F.lit(1)).cast("double"))


def sample_key(seed: str = SEED):
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: one row per source (source, source_size); with its target."""
    everything = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int")))
    most = F.lit(float(cap)) * F.col("source_size")
    weighed = weighed.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("full_at", most / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("budget") - capped) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return leveled.withColumn("open_level", open_level).select("source", "source_size", F.when(F.col("level") < F.col("full_at"), F.col("open_level") * F.col("weight")).otherwise(most).alias("target"))


def _by_distinct_rows(rows: DataFrame, cell_rows: int) -> DataFrame:
    """rows of crowded buckets with `inside`, the words of the bucket's rows before them: distinct rows are summed, equal rows numbered in parts."""
    same = ["source", "bucket", "key", "doc_id", "size"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("ahead", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)))
    groups = groups.withColumn("parts", F.ceil(F.col("n") / cell_rows)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_group = F.expr(" AND ".join(f"r.{c} <=> g.{c}" for c in [*same, "salt"]))
    rows = rows.withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")).alias("r").join(groups.alias("g"), of_group).select("r.*", "g.ahead", "g.parts").drop("salt")
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts"))), "mix-crowded")
    parts = rows.groupBy(*same, "part").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("first", F.coalesce(so_far, F.lit(0)))
    number = F.row_number().over(Window.partitionBy(*same, "part").orderBy("_row")) - 1
    in_part = F.expr(" AND ".join(f"r.{c} <=> p.{c}" for c in [*same, "part"]))
    rows = rows.withColumn("number", number).alias("r").join(parts.alias("p"), in_part).select("r.*", "p.first")
    return rows.withColumn("inside", F.col("ahead") + (F.col("first") + F.col("number")) * F.col("size")).drop("ahead", "parts", "part", "number", "first")


def mixed(docs: DataFrame, keep: list[str] | None = None, seed: str = SEED, buckets: int = BUCKETS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs (doc_id, text, source) with size, source_size, target, copies and taken (copies times size)."""
    keep = keep or []
    rows = docs.select("doc_id", "source", n_words().alias("size"), (sample_key(seed) / quality_weight()).alias("key"), F.monotonically_increasing_id().alias("_row"), *keep)
    rows = written(rows.withColumn("bucket", F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")), "mix-keys")
    # one row per source and bucket, from partial sums
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell"), F.count("*").alias("rows"))
    sources = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")))
    before = F.sum("cell").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    crowded = (F.col("rows") > cell_rows) & (F.col("rows") * buckets > CROWDED * F.sum("rows").over(Window.partitionBy("source")))
    cells = written(cells.withColumns({"before": F.coalesce(before, F.lit(0)), "crowded": crowded}), "mix-cells")
    cells = cells.alias("c").join(sources.alias("s"), F.expr("c.source <=> s.source")).select(F.col("c.source").alias("source"), "bucket", "before", "crowded", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cells = cells.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(within), F.lit(0))
    of_cell = F.expr("r.source <=> k.source AND r.bucket = k.bucket")
    hot = cells.where("crowded").select("source", "bucket").alias("k")
    if hot.isEmpty():
        rows = rows.withColumn("inside", inside)
    else:
        usual, many = rows.alias("r").join(F.broadcast(hot), of_cell, "left_anti"), rows.alias("r").join(F.broadcast(hot), of_cell, "left_semi")
        rows = usual.withColumn("inside", inside).unionByName(_by_distinct_rows(many, cell_rows))
    out = rows.alias("r").join(cells.alias("c"), F.expr("r.source <=> c.source AND r.bucket = c.bucket")).select("r.*", "c.before", "c.source_size", "c.target", "c.epochs", "c.rest")
    middle = F.col("before") + F.col("inside") + F.col("size") / F.lit(2.0)
    # a document without words takes nothing from the budget: it comes with the whole epochs, and with the rest if that goes beyond its place
    out = out.withColumn("copies", F.col("epochs") + F.when(F.col("size") > 0, middle <= F.col("rest")).otherwise(middle < F.col("rest")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


ORACLE = """
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           length(coalesce(text, '')) AS n, length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS plain,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents
), k AS (
    SELECT doc_id, source, size, -ln(u) / (1::DOUBLE / (1::DOUBLE + 20::DOUBLE * (n - plain)::DOUBLE / greatest(n, 1)::DOUBLE)) AS key FROM d
), s0 AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), s1 AS (
    SELECT *, [3::DOUBLE, 1::DOUBLE, 2::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
           1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s0
), s2 AS (
    SELECT *, 2::DOUBLE * source_size AS most, 2::DOUBLE * source_size / weight AS full_at FROM s1
), s3 AS (
    SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
), s4 AS (
    SELECT source, source_size,
           CASE WHEN level < full_at THEN weight * (SELECT arg_min(level, full_at) FROM s3 WHERE level < full_at) ELSE most END AS target FROM s3
), s5 AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s4
), r AS (
    SELECT k.doc_id, k.size, s.source_size, s.target, s.epochs,
           coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + k.size / 2::DOUBLE AS middle
    FROM k JOIN s5 s ON k.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       (size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
