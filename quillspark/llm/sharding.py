"""Sharding by fixed virtual slots (op 6), with DataFrame functions only.

Records hash by id and text into SLOTS slots (equal records of more bytes than a slot's share by a row number too, so they can part); the bytes of each slot are summed; a versioned table maps slots to shards. Its first
version deals slots out in turn, before any size is known; rebalanced() edits the latest version by the slots' bytes, or for another
shard count, and stores the next, so that shards' bytes are near equal (law `bytes`). A version is a folder of its own, which can't be
written twice. Only the map and the slots' sums (SLOTS rows) are ever collected or broadcast.

A record's slot in the result is its place in its shard, gapless from 0: cells (virtual slot, part) are numbered apart and put one
after the other, so no task sorts a whole shard. A slot of many rows has many parts, also where its rows are all equal.

Defined results: size is the text's UTF-8 bytes (null: 0) plus 16; a null id hashes as a value of its own; repeated rows get
places of their own, in any order, and shards of their own where they are many; slots of equal bytes move in order of their number; an empty table gives no rows; extra columns
are not read. A very long text is one record; one larger than a shard's share can't be split.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table, written

SLOTS, SHARDS = 4096, 40
#: Rows of a cell, about: what one task numbers at a time.
CELL_ROWS = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hash, row, vslot). row is any number of the record's own; what is written keeps it."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("vslot", F.pmod("hash", F.lit(SLOTS)).cast("int"))


def parted(rows: DataFrame) -> DataFrame:
    """rows (written, of sized()) with equal records dealt to all slots where they have more bytes than a slot's share.

    Only the rows of slots of twice that share are looked at, and at most SLOTS hashes can have so many bytes.
    """
    sums = slot_bytes(rows)
    share = sum(b for b, _ in sums.values()) / SLOTS
    crowded = [v for v, (b, n) in sums.items() if b > 2 * share and n > 1]
    if not crowded:
        return rows
    many = rows.where(F.col("vslot").isin(crowded)).groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > share))
    hashes = [(r["hash"], True) for r in many.select("hash").collect()]  # SLOTS at most
    if not hashes:
        return rows
    dealt = rows.join(F.broadcast(rows.sparkSession.createDataFrame(hashes, "hash long, many boolean")), "hash", "left")
    vslot = F.when(F.col("many"), F.pmod(F.xxhash64("hash", "row"), F.lit(SLOTS)).cast("int")).otherwise(F.col("vslot"))
    return written(dealt.select("doc_id", "size", "text_crc32", "hash", "row", vslot.alias("vslot")), "op6-parted")


def slot_bytes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; SLOTS entries at most."""
    return {r["vslot"]: (r["bytes"], r["rows"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}


def assign(sizes: dict[int, int], shards: int = SHARDS) -> dict[int, int]:
    """A new map of all slots: the largest first, each to the shard that has least."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(SLOTS), key=lambda v: (-sizes.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.01, even: bool = False) -> dict[int, int]:
    """The old map with slots moved from shards that are over their share (or gone) to the lightest ones, until all are within slack.

    Small slots stay first, so few need to move. With even, large ones are settled first and each at once, so that loads come out even.
    """
    out, load = dict(old), [0] * shards
    most = sum(sizes.values()) / shards * (1 + slack)
    loose = []
    for slot in sorted(out, key=lambda v: (sizes.get(v, 0) * (-1 if even else 1), v)):
        if out[slot] < shards and load[out[slot]] + sizes.get(slot, 0) <= most:
            load[out[slot]] += sizes.get(slot, 0)
        elif even:
            out[slot] = load.index(min(load))
            load[out[slot]] += sizes.get(slot, 0)
        else:
            loose.append(slot)
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    for slot in reversed(loose):
        x, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (x + sizes.get(slot, 0), shard))
    return out


MAP = "vslot int, shard int"


def store_map(spark: SparkSession, path: str, mapping: dict[int, int], version: int) -> None:
    """Write a version, once; an error if it is there."""
    spark.createDataFrame(sorted(mapping.items()), MAP).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are there in whole, ascending."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    done = [x.getName() for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.partition("=")[2]) for x in done if x.startswith("version="))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest if none is named."""
    return spark.read.schema(MAP).parquet(f"{path}/version={versions(spark, path)[-1] if version is None else version}")


def rebalanced(spark: SparkSession, path: str, sizes: dict[int, int], shards: int, slack: float = 0.01, even: bool = False) -> int:
    """Edit the latest version by these sizes and store the next, whose number is returned."""
    version = versions(spark, path)[-1]
    old = {r["vslot"]: r["shard"] for r in load_map(spark, path, version).collect()}  # SLOTS rows
    store_map(spark, path, rebalance(old, sizes, shards, slack, even), version + 1)
    return version + 1


def placed(rows: DataFrame, mapping: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows (of sized()) with their shard and their place in it. counts: rows per slot."""
    parts = rows.sparkSession.createDataFrame([(v, -(-n // CELL_ROWS)) for v, n in counts.items()], "vslot int, parts int")
    mapping = F.broadcast(mapping.join(F.broadcast(parts), "vslot"))  # SLOTS rows
    rows = rows.join(mapping, "vslot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    cells = rows.groupBy("vslot", "part", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("vslot", "part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("row")) - 1
    return rows.withColumn("number", number).join(cells, ["vslot", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parted(written(sized(table(spark, sf_dir, "documents", "doc_id", "text")), "op6-sizes"))
    sums = slot_bytes(rows)
    path = new_path(spark, "op6-map")
    store_map(spark, path, {v: v % SHARDS for v in range(SLOTS)}, version=1)
    rebalanced(spark, path, {v: b for v, (b, _) in sums.items()}, SHARDS, slack=0.0, even=True)
    return placed(rows, load_map(spark, path), {v: n for v, (_, n) in sums.items()})
