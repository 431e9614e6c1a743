"""Shuffles of many short rows as compressed Arrow tables: as rows of Spark they take several times what they take when they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task packs at a time.
ROWS = 1 << 19


def codec():
    """(an Arrow table to bytes, and back), as functions that go to workers whole: these need not have this module. Texts and numbers that come again are numbered."""
    import pyarrow as pa

    def numbered(x):
        coded = x.dictionary_encode() if pa.types.is_string(x.type) or pa.types.is_floating(x.type) else x
        return coded if coded is not x and 2 * len(coded.dictionary) < len(coded) else x

    def pack(t) -> bytes:
        t = t.combine_chunks()
        t = pa.table([numbered(x.chunk(0)) if x.num_chunks else x for x in t.columns], names=t.column_names)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t.combine_chunks())
        return out.getvalue().to_pybytes()

    def unpack(data):
        t = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()
        return pa.table([x.chunk(0).dictionary_decode() if pa.types.is_dictionary(x.type) else x for x in t.columns], names=t.column_names)

    return pack, unpack


def dealt(df: DataFrame, part: Column, parts: int, whole=None, schema=None, by_token: bool = True) -> DataFrame:
    """Rows of df by part, a number below parts, as so many partitions. by_token: equal tokens are packed one after another; else rows are as they come.

    With whole, a partition's rows go through it as one Arrow table, which gives a table of schema; else pack by pack.
    """
    import numpy as np
    import pyarrow as pa

    pack, unpack = codec()

    def packs(t):
        order = np.arange(t.num_rows)
        if by_token:
            coded = t.column("token").combine_chunks().dictionary_encode()
            rank = np.empty(len(coded.dictionary) + 1, np.int64)
            rank[np.append(coded.dictionary.to_numpy(zero_copy_only=False).argsort(), len(coded.dictionary))] = np.arange(len(rank))
            order = np.argsort(rank[coded.indices.fill_null(len(coded.dictionary)).to_numpy()], kind="stable")
        at = t.column("_part").to_numpy()[order]
        by_part = np.argsort(at, kind="stable")
        at, t = at[by_part], t.drop_columns(["_part"]).take(pa.array(order[by_part]))
        edges = np.append(np.append(0, np.flatnonzero(np.diff(at)) + 1), len(at))
        return pa.RecordBatch.from_pydict({"part": pa.array(at[edges[:-1]], pa.int32()), "packed": pa.array([pack(t.slice(a, z - a)) for a, z in zip(edges, edges[1:])], pa.binary())})

    def run(batches):
        kept, n = [], 0
        for b in batches:
            kept, n = [*kept, b], n + b.num_rows
            if n >= ROWS:
                yield packs(pa.Table.from_batches(kept))
                kept, n = [], 0
        if n:
            yield packs(pa.Table.from_batches(kept))

    def gather(batches):
        tables = (unpack(x) for b in batches for x in b.column("packed"))
        if whole is None:
            for t in tables:
                yield from t.combine_chunks().to_batches(8192)
        elif tables := list(tables):
            yield from whole(pa.concat_tables(tables)).combine_chunks().to_batches(8192)

    rows = df.withColumn("_part", part.cast("int")).mapInArrow(run, "part int, packed binary").repartitionById(parts, "part").select("packed")
    return rows.mapInArrow(gather, schema or df.schema)
