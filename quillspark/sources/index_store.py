"""Index generations: immutable tables under <root>/gen=<id>/, and pointers <root>/current/<number> that name them in turn.

A generation is written whole, its files' digests are put under one root in its manifest (digests), and only then is it made current, by a pointer of the next number; the greatest
number counts. Whoever loads tables holds their files against that root. A pointer is never changed, so a reader (or a crash) at any moment finds the old generation or the new one.
Old generations stay until removed by drop_generation().
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import packed
from quillspark.buckets import BUCKETS
from quillspark.sources import digests

VERSION = 2
#: Of stored tables: texts and tokens take about two thirds of what they take with Spark's default.
CODEC = "zstd"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new file, by a rename of a whole one in the same folder. Whether it was new."""
    jvm, fs, p = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(p) and fs.rename(part, p):
        return True
    fs.delete(part, False)
    return False


def _pointers(spark: SparkSession, root: str, folder: str = "current") -> list[str]:
    jvm, fs, p = _fs(spark, f"{root}/{folder}")
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm, fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; on one machine where it is unset, a folder made for the session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a Parquet table's files."""
    _, fs, p = _fs(spark, path)
    own = digests.statuses(spark, fs.listStatus(p))
    return "\n".join(sorted(":".join(x) for x in own) + ["/".join(map(str, x)) for x in sorted(digests.listed(spark, path))])


def write_table(df: DataFrame, path: str) -> None:
    """Tables with a column `bucket` have a folder for each, sorted by token, so that a reader of some tokens reads some folders.

    So have those with a column `ball`. A bucket is written by as many tasks as its share of spark.sql.shuffle.partitions, a frequent token's rows too.
    """
    if "bucket" in df.columns:
        spark = df.sparkSession
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        rows = packed.dealt(df, F.col("bucket") * parts + F.pmod(F.xxhash64("id"), F.lit(parts)), BUCKETS * parts)
        rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path, compression=CODEC)
    elif "ball" in df.columns and "id" in df.columns:
        parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        df.repartition("ball", F.pmod(F.xxhash64("id"), F.lit(parts))).write.partitionBy("ball").parquet(path, compression=CODEC)
    else:
        df.write.parquet(path, compression=CODEC)


def save(spark: SparkSession, root: str, tables: dict, meta: dict | None = None, activate=lambda manifest: True) -> str:
    """Write a generation and make it current if activate(manifest) allows it.

    tables: name -> DataFrame, or a function from the tables written so far, so that what follows from a table reads it and isn't made twice.
    """
    gen = uuid.uuid4().hex
    base, done = f"{root}/gen={gen}", {}
    manifest = {"version": VERSION, "generation": gen, "meta": meta or {}, "tables": {}}
    for name, df in tables.items():
        df = df(done) if callable(df) else df
        write_table(df, f"{base}/{name}")
        done[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}").select(df.columns)
        manifest["tables"][name] = {"schema": json.loads(df.schema.json())}
    manifest["root"] = digests.record(spark, base)
    _write_text(spark, f"{base}/manifest.json", json.dumps(manifest, sort_keys=True))
    if not activate(manifest):
        raise RuntimeError("activation was refused: the corpus has changed meanwhile")
    while not _write_text(spark, f"{root}/current/{int((_pointers(spark, root) or ['0'])[-1]) + 1:020d}", gen):
        pass  # another writer was first
    return gen


def current(spark: SparkSession, root: str) -> str | None:
    found = _pointers(spark, root)
    text = _read_text(spark, f"{root}/current/{found[-1]}") if found else None
    return text.strip() if text else None


def manifest(spark: SparkSession, root: str, gen: str) -> dict:
    text = _read_text(spark, f"{root}/gen={gen}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"generation {gen} has no manifest")
    found = json.loads(text)
    if found.get("version") != VERSION or found.get("generation") != gen or not isinstance(found.get("tables"), dict) or not isinstance(found.get("root"), str):
        raise ValueError(f"the manifest of generation {gen} doesn't fit")
    return found


def load(spark: SparkSession, root: str, gen: str | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a generation, the current one by default, or some of them; none if there is no index. Files that aren't as they were written are refused."""
    gen = gen or current(spark, root)
    if gen is None:
        return {}
    from pyspark.sql.types import StructType

    found, base = manifest(spark, root, gen), f"{root}/gen={gen}"
    schemas = {name: StructType.fromJson(t["schema"]) for name, t in found["tables"].items() if names is None or name in names}
    there = [f for f, _, _ in digests.listed(spark, base)]
    digests.check(spark, base, found["root"], None if names is None else [f for f in there if f.split("/", 1)[0] in schemas])
    return {name: spark.read.schema(x).parquet(f"{base}/{name}").select(x.fieldNames()) for name, x in schemas.items()}


def verify(spark: SparkSession, root: str, gen: str) -> None:
    """All files of a generation; ValueError says which differ."""
    digests.check(spark, f"{root}/gen={gen}", manifest(spark, root, gen)["root"])


def compatible(a: dict, b: dict) -> bool:
    """Whether two generations' settings (provider, model, dimension, splitter ...) agree, so that vectors may be reused."""
    return a.get("meta") == b.get("meta") and a.get("version") == b.get("version")


def generations(spark: SparkSession, root: str) -> list[str]:
    """All whole generations that are there, current or not."""
    _, fs, p = _fs(spark, root)
    found = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
    names = [x.getName().removeprefix("gen=") for x in found if x.getName().startswith("gen=")]
    return sorted(g for g in names if _read_text(spark, f"{root}/gen={g}/manifest.json"))


def drop_generation(spark: SparkSession, root: str, gen: str) -> None:
    if gen == current(spark, root):
        raise ValueError("the current generation can't be dropped")
    _, fs, p = _fs(spark, f"{root}/gen={gen}")
    fs.delete(p, True)
