"""Media columns (op 3): payloads as 8-bit images in archives, read back by a Spark data source of our own.

An archive is a ZIP file of stored members, each a PNG of 8-bit grey samples, WIDTH to a row (lossless; the unpadded length is
a tEXt chunk, so equal contents give equal files). One write task makes one or more archives of about ARCHIVE_BYTES; the commit
lists those of successful task attempts in a manifest, so failed or repeated attempts leave nothing that is read.

Reading plans partitions as byte ranges of archives: a task reads its archive's directory (at the end of the file) and takes the
members that begin in its range, in offset order, and gives Arrow batches of about BATCH_BYTES. A member that can't be read or
fails its checksum is tried again by its own offset on a newly opened file, RETRIES times; then the task fails, and Spark
runs it anew. Nothing is skipped.

Defined results: null text is the empty text, whose payload is 192 spaces; a very long text is one member, held whole by the task that
writes or reads it, and a batch of its own; null doc_id stays null; repeated rows are members of their own, equal ids too, in any
order; an empty table gives a manifest without archives and no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import new_path, table

#: Samples in an image row; payloads are padded with spaces to a positive multiple of it.
WIDTH = 192
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 1 << 28, 1 << 25, 1 << 22, 3
#: Ranges planned, about, at most: beyond, they are larger, up to an archive each.
RANGES = 100_000
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_archives.json"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(content: bytes) -> bytes:
    rows = max(1, -(-len(content) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter: none
    lines[:, 1:] = np.frombuffer(content.ljust(rows * WIDTH, b" "), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(content)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, bytes]:
    """Unpadded length and payload."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, n_bytes, data, rows = 8, None, b"", 0
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            rows = struct.unpack(">I", body[4:8])[0]
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return n_bytes, lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, share of steps across the mean, and the shares of eight sample bands."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    mean = x.mean()
    bands = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8) / len(x)
    return f"mean={mean:.4f};std={x.std():.4f};cross={np.mean((x[1:] > mean) != (x[:-1] > mean)):.4f};bands=" + ",".join(f"{b:.4f}" for b in bands)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Wrote(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, base = _filesystem(self.path)
        done: list[tuple[str, int]] = []
        zipped = out = None
        for batch in iterator:
            for key, content in zip(batch.column(0), batch.column(1)):
                if zipped is None:
                    name, number = f"{uuid.uuid4().hex}.zip", 0
                    out = store.open_output_stream(f"{base}/{name}")
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                member = zipfile.ZipInfo(f"{number}-{'null' if key.as_py() is None else key.as_py()}.png")
                zipped.writestr(member, to_png(content.as_py() or b""))
                number += 1
                if out.tell() >= ARCHIVE_BYTES:
                    zipped.close()
                    done.append((name, out.tell()))
                    out.close()
                    zipped = None
        if zipped is not None:
            zipped.close()
            done.append((name, out.tell()))
            out.close()
        return Wrote(done)

    def commit(self, messages) -> None:
        store, base = _filesystem(self.path)
        with store.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(a for m in messages if m is not None for a in m.archives)).encode())

    def abort(self, messages) -> None:
        store, base = _filesystem(self.path)
        for m in messages:
            for name, _ in m.archives if m is not None else ():
                store.delete_file(f"{base}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        store, base = _filesystem(self.path)
        with store.open_input_stream(f"{base}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        step = max(RANGE_BYTES, min(ARCHIVE_BYTES, sum(size for _, size in archives) // RANGES))
        return [ByteRange(name, at, min(size, at + step)) for name, size in archives for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, base = _filesystem(self.path)
        place = f"{base}/{partition.archive}"
        with store.open_input_file(place) as f, zipfile.ZipFile(_Seekable(f)) as z:
            members = sorted((m for m in z.infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)
        keys, media, size = [], [], 0
        source = None
        for m in members:
            for attempt in range(RETRIES + 1):
                try:
                    source = source or store.open_input_file(place)
                    raw = read_member(source, m)
                    break
                except (OSError, ValueError):
                    source = None  # opened anew, for this member's offset alone
                    if attempt == RETRIES:
                        raise
                    time.sleep(0.1 * 2**attempt)
            key = m.filename.split("-", 1)[1].removesuffix(".png")
            keys.append(None if key == "null" else int(key))
            media.append(raw)
            size += len(raw)
            if size >= BATCH_BYTES:
                yield self._batch(keys, media)
                keys, media, size = [], [], 0
        if keys:
            yield self._batch(keys, media)

    def _batch(self, keys, media) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], names=self.names)


class _Seekable(io.RawIOBase):
    """A pyarrow file as zipfile wants it."""

    def __init__(self, f):
        self.f = f

    def read(self, n=-1):
        return self.f.read(None if n is None or n < 0 else n)

    def seek(self, at, whence=0):
        self.f.seek(at, whence)
        return self.f.tell()

    def tell(self):
        return self.f.tell()

    def seekable(self):
        return True

    def readable(self):
        return True


def read_member(f, member: zipfile.ZipInfo) -> bytes:
    head = f.read_at(30, member.header_offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {member.header_offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    raw = f.read_at(member.file_size, member.header_offset + 30 + name + extra)
    if len(raw) != member.file_size or zlib.crc32(raw) != member.CRC:
        raise ValueError(f"member {member.filename} at {member.header_offset} is damaged")
    return raw


class PayloadArchive(DataSource):
    """format("payload_archive"): save (doc_id, content) to archives, load (doc_id, media) from them."""

    @classmethod
    def name(cls) -> str:
        return "payload_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema)

    def writer(self, schema, overwrite) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archives(docs: DataFrame, path: str) -> None:
    """docs: doc_id and text; the archives hold every text's UTF-8."""
    docs.sparkSession.dataSource.register(PayloadArchive)
    store, base = _filesystem(path)
    store.create_dir(base)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).write.format("payload_archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PayloadArchive)
    return spark.read.format("payload_archive").load(path)


def describe(media: DataFrame) -> DataFrame:
    """The payload that each stored image holds, and its features."""

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column(1):
                raw = m.as_py()
                n, payload = from_png(raw)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 7, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op3")
    write_archives(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return describe(read_archives(spark, path))
