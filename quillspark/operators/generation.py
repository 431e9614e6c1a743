"""Answers from a generator that may fail, kept as they come: what is done once isn't asked for again.

Prompts are named by their digest. They go in waves; a wave's answers are appended to a log (Parquet in a shared folder) by one commit of Spark's
writer, so after a crash, a lost executor or a stopped job the next run asks for what the log lacks only. Within a wave a batch that fails is tried
again, with a pause that doubles; one that fails `tries` times is logged with its error, and asked for again by the next run alone.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources import index_store

LOG = "key string, answer string, error string"


def logged(spark, log: str) -> DataFrame:
    """(key, answer, error) of all finished calls: an answer, once there is one, rather than an error."""
    _, fs, p = index_store._fs(spark, log)
    rows = spark.read.schema(LOG).parquet(log) if fs.exists(p) else spark.createDataFrame([], LOG)
    return rows.groupBy("key").agg(F.min("answer").alias("answer"), F.max("error").alias("error")).withColumn("error", F.when(F.col("answer").isNull(), F.col("error")))


def answered(prompts: DataFrame, generate, log: str, batch: int = 16, tries: int = 4, pause: float = 0.5, wave: int = 10_000) -> DataFrame:
    """prompts (prompt, and other columns) with answer and error. generate(list of prompts) -> list of as many answers.

    Equal prompts are asked once; a null prompt has a null answer and isn't asked.
    """
    import pyarrow as pa

    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))

    def call(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                texts, found, error = part.column(1).to_pylist(), None, None
                for n in range(tries):
                    if n:
                        time.sleep(pause * 2 ** (n - 1))
                    try:
                        found = list(generate(texts))
                        if len(found) != len(texts):
                            raise ValueError(f"{len(found)} answers to {len(texts)} prompts")
                        break
                    except Exception as e:  # whatever a provider raises
                        found, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found or [None] * len(texts), pa.string()), pa.array([None if found else error] * len(texts), pa.string())], names=["key", "answer", "error"])

    todo = keyed.where("prompt IS NOT NULL").groupBy("key").agg(F.min("prompt").alias("prompt"))
    index_store.shared_folder(spark)
    todo = todo.join(logged(spark, log).where("answer IS NOT NULL").select("key"), "key", "left_anti").checkpoint()
    waves = max(1, -(-todo.count() // wave))
    for k in range(waves):
        some = todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k) if waves > 1 else todo
        some.mapInArrow(call, LOG).write.mode("append").parquet(log)
    return keyed.join(logged(spark, log), "key", "left").drop("key")
