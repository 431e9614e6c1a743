"""Digests of stored files as a tree: one root in a manifest speaks for every byte, and a reader checks the files it reads and no others.

A leaf is the SHA-256 of a file's name and bytes, a branch that of its leaves in order; branches go by the first hex digits of the name's hash, so any
number of files makes FANOUT branches, and one file is checked with its own branch and the branches' digests.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits by which leaves are dealt to branches: 256 branches.
DIGITS = 2
SCHEMA = "file string, length long, modified long, leaf string, branch string"
#: What this process has found as it should be: files of a root (base, root, file, length, time of change), roots, and the files of roots checked as a whole.
_seen: set[tuple] = set()
_roots: set[tuple] = set()
_whole: dict[tuple, frozenset] = {}


def leaves(spark: SparkSession, base: str, files: list[str] | None = None) -> DataFrame:
    """SCHEMA of the Parquet files below base, or of some of them; names are relative to base."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{base}/{f}" for f in files] if files else base)
    marker = base.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", f"{marker}/(.*)$", 1)
    leaf = F.sha2(F.concat(F.encode(F.concat(name, F.lit("\n")), "UTF-8"), F.col("content")), 256)
    return raw.select(name.alias("file"), "length", F.unix_micros("modificationTime").alias("modified"), leaf.alias("leaf"), F.substring(F.sha2(name, 256), 1, DIGITS).alias("branch"))


def branches(rows: DataFrame) -> dict[str, str]:
    """The digest of each branch; 16 ** DIGITS at most."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "leaf"))), lambda x: x["leaf"]), "")
    return {r["branch"]: r["digest"] for r in rows.groupBy("branch").agg(F.sha2(own, 256).alias("digest")).collect()}


def root(digests: dict[str, str]) -> str:
    return hashlib.sha256("".join(f"{b}:{d}\n" for b, d in sorted(digests.items())).encode()).hexdigest()


def gathered(rows: DataFrame) -> DataFrame:
    """Digests in one file. Only they come together: many tasks read the bytes (coalesce would have one read all)."""
    return rows.repartition(1)


def record(spark: SparkSession, base: str) -> str:
    """Write the leaves of what is stored below base to base/_leaves and return the root. Bytes are read once and not decoded."""
    there = listed(spark, base)
    if there:
        gathered(leaves(spark, base)).write.json(f"{base}/_leaves")
    else:
        spark.createDataFrame([], SCHEMA).write.json(f"{base}/_leaves")
    found = root(branches(recorded(spark, base)))
    # they were read just now
    _roots.add((base, found))
    _seen.update((base, found, *x) for x in there)
    _whole[base, found] = frozenset(f for f, _, _ in there)
    return found


def recorded(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(f"{base}/_leaves")


def check(spark: SparkSession, base: str, want: str, files: list[str] | None = None) -> None:
    """Refuse, with ValueError, leaves that don't have the root, and files (all by default) that don't have their leaves. A file is read once per process and state of it."""
    there, key = {f: (n, t) for f, n, t in listed(spark, base)}, (base, want)
    if key in _roots and (files is not None or _whole.get(key) == frozenset(there)) and all(f in there and (*key, f, *there[f]) in _seen for f in (files if files is not None else there)):
        return
    rows = recorded(spark, base)
    if key not in _roots and root(branches(rows)) != want:
        raise ValueError(f"the digests of {base} are not those of its manifest")
    _roots.add(key)
    known = {r["file"]: r["leaf"] for r in (rows if files is None else rows.where(F.col("file").isin(files))).select("file", "leaf").collect()}
    wanted = sorted(known) if files is None else files
    if missing := [f for f in wanted if f not in known or f not in there]:
        raise ValueError(f"files of {base} are missing or unknown: {', '.join(missing[:3])}")
    if files is None and (more := sorted(set(there) - set(known))):
        raise ValueError(f"{base} has files that its manifest doesn't know: {', '.join(more[:3])}")
    fresh = [f for f in wanted if (*key, f, *there[f]) not in _seen]
    bad = [r["file"] for r in leaves(spark, base, fresh).select("file", "leaf").collect() if r["leaf"] != known[r["file"]]] if fresh else []
    if bad:
        raise ValueError(f"files of {base} are not as they were written: {', '.join(bad[:3])}")
    _seen.update((*key, f, *there[f]) for f in fresh)
    if files is None:
        _whole[key] = frozenset(there)


STATUS = re.compile(r"\{path=(.*?); isDirectory=false; length=(\d+);.*?modification_time=(\d+);")


def statuses(spark: SparkSession, found) -> list[tuple[str, str, str]]:
    """(path, length, time of change) of the files in a Java array of statuses (or none), which come over as one text."""
    return STATUS.findall(spark.sparkContext._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(found).mkString("\n")) if found is not None else []


def listed(spark: SparkSession, base: str) -> list[tuple[str, int, int]]:
    """(file, length, time of change) of the Parquet files up to three folders below base; one call of the file system per depth."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marker, out = base.rstrip("/").rsplit("/", 1)[-1] + "/", []
    for depth in range(4):
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{'*/' * depth}*.parquet"))
        out += [(name.split(marker, 1)[1], int(n), int(t)) for name, n, t in statuses(spark, found)]
    return out
