"""Token-ID output (op 1): canonical length-limited Huffman coding of ids.

The files: a folder `blocks/` of Parquet rows, each one independent block of documents in ascending doc_id order, and
`codebook/` with the length of each id's code (canonical codes follow from the lengths alone). A block row holds

    shard, block           its place; shards ascend with doc_id, blocks ascend within a shard
    first                  ids in this shard before the block
    doc_ids, counts        per document its id and number of token ids
    offsets                bit offset of each segment (STEP ids at most; each document starts one, on a whole byte)
    payload                the code bits

Steps: tokenise once (written as a table) -> count ids over all documents -> package-merge code lengths on the driver
(one number per vocabulary entry) -> encode -> place by doc_id range -> pack into blocks. Decoding a block is table-driven
and takes all its segments in lock step from their bit offsets; it needs nothing but the block and the codebook.

Defined results: null text is the empty text; a very long text is encoded in pieces cut between words, and is one document in one block;
null doc_id sorts first; repeated rows are kept, each as a document of its own (documents of one doc_id, or of none, stand in any
order, over as many shards as they need); ids as often as each other are ordered by number in the codebook; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, held, new_path, table, written
from .units import Memo, bytes_of, gathered, pieces, slices, strings

#: Longest code in bits; the decoding table has 2**MAX_BITS entries.
MAX_BITS = 18
#: Ids between two bit-offset checkpoints.
STEP = 128
#: Ids in a block, about (a block ends with a document), and in a shard.
BLOCK_IDS, SHARD_IDS = 1 << 19, 1 << 25
#: Bytes of a worker's memo of units, and of texts that are encoded at a time.
MEMO_BYTES, SLICE = 48 << 20, 1 << 23
#: Classes of bytes: white space, letters (A-Z, a-z), marks; all others are odd, the apostrophe too, as contractions begin with it.
SPACE, LETTER, MARK, ODD = range(4)
_class = np.full(256, ODD, np.uint8)
_class[[9, 10, 11, 12, 13, 32]] = SPACE
_class[[*range(65, 91), *range(97, 123)]] = LETTER
_class[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: A run of lower-case Latin letters or of marks.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+").fullmatch


class WordEncoder:
    """ids of whole texts by the tokenizers library, which sees each distinct unit once per memo fill.

    Exact for a tokenizer whose pre-tokens never span white space: its normalizer works on code points (NFC composes nothing
    with a space) and its pattern drops white space. A unit is a word between white space. Where the tokenizer lowers case and takes a
    run of letters as one pre-token and a run of marks as another, words of Latin letters and marks alone are cut into such runs, in
    lower case. Words that could hold a special token (which the library looks for in the text as it stands) are never cut.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        steps = {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])}
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        vocab = self.tokenizer.get_vocab()
        special = [x["content"] for x in spec.get("added_tokens", [])]
        # a word that holds a special token has its first two characters, which no run of letters or marks may then span
        self.marked = [x[:2].encode() for x in special]
        self.cut = "Lowercase" in steps and steps <= {"NFC", "Lowercase", "Replace"} and [x["type"] for x in splits] == ["Split", "ByteLevel"] and all(len(x) > 2 and not x[:2].isalnum() for x in special)
        if self.cut:
            spec["normalizer"], splits[0] = None, {"type": "WhitespaceSplit"}
            self.plain_tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = Memo(MEMO_BYTES, np.uint16 if len(self.ends) <= 65536 else np.uint32)

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts in order, and how many each text has."""
        raw, at = bytes_of(pc.binary_join_element_wise(texts, "", " "))
        kind = _class[raw]
        plain = _lower[raw]
        lead = np.flatnonzero(raw == 0xC3)  # À to ÿ but × and ÷
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        upper = lead[raw[lead + 1] < 0x9F] + 1
        plain[upper] += 0x20
        for a, b in self.marked:
            kind[:-1][(raw[:-1] == a) & (raw[1:] == b)] = ODD
        changes = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.concatenate([[0], changes]) if len(kind) else changes
        ends = np.append(changes, len(kind))[: len(starts)]
        some = kind[starts] != SPACE
        starts, ends = starts[some], ends[some]
        # words: runs that touch belong to one
        first = np.ones(len(starts), bool)
        first[1:] = starts[1:] > ends[:-1]
        word = np.cumsum(first) - 1
        odd = np.full(int(word[-1]) + 1 if len(word) else 0, not self.cut)
        odd[word[kind[starts] == ODD]] = True
        inside = ~(odd[word] & ~first)
        lengths = ends - starts
        sizes = np.bincount(word, lengths, len(odd)).astype(np.int64)
        white = kind == SPACE
        data = np.where(np.repeat(odd, sizes), raw[~white], plain[~white])
        lengths = np.where(odd[word], sizes[word], lengths)[inside]
        return strings(data, lengths), np.diff(np.searchsorted(starts[inside], at))

    def _learn(self, units: pa.Array) -> list:
        units = units.to_pylist()
        is_plain = np.fromiter((self.cut and PLAIN(u) is not None for u in units), bool, len(units))
        plain, odd = [u for u, p in zip(units, is_plain) if p], [u for u, p in zip(units, is_plain) if not p]
        kind, lengths = self.memo.dtypes[0], np.zeros(len(units), np.int64)
        parts = [" ".join(plain[k : k + 1000]) for k in range(0, len(plain), 1000)]
        got = [np.array(e.ids, kind) for e in self.plain_tokenizer.encode_batch_fast(parts, add_special_tokens=False)] if parts else []
        own = np.concatenate([np.zeros(0, kind), *got])
        lengths[is_plain] = np.diff(np.flatnonzero(self.ends[own]) + 1, prepend=0)
        got = [np.array(e.ids, kind) for k in range(0, len(odd), 1000) for e in self.tokenizer.encode_batch_fast(odd[k : k + 1000], add_special_tokens=False)]
        lengths[~is_plain] = np.fromiter(map(len, got), np.int64, len(got))
        both, order = np.concatenate([own, *got]), np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        begin = np.zeros(len(units), np.int64)
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        return [(gathered(both, begin, lengths), lengths)]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts, owner = pieces(texts, SLICE)
        found, total = [np.zeros(0, self.memo.dtypes[0])], np.zeros(len(texts), np.int64)
        for at, some in slices(parts, SLICE):
            units, counts = self._units(some)
            ids, lengths = self.memo.runs[0].of(self.memo.find(units, self._learn))
            found.append(ids)
            np.add.at(total, owner[at : at + len(some)], np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]))
        return np.concatenate(found), total


def tokenise(docs: DataFrame, tokenizer_json: str, end_id: int | None) -> DataFrame:
    """(doc_id, n, ids): ids as little-endian unsigned 16-bit numbers where the vocabulary allows, else 32-bit."""

    def run(batches):
        enc = held(("words", tokenizer_json), lambda: WordEncoder(tokenizer_json))
        dtype = "<u2" if len(enc.ends) <= 65536 else "<u4"
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                ids, counts = enc.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                raw = np.ascontiguousarray(ids, dtype).tobytes()
                cuts = np.concatenate([[0], np.cumsum(counts)]) * int(dtype[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def id_counts(tokens: DataFrame, vocab_size: int) -> np.ndarray:
    """How often each id occurs in all documents. Each task sends a row per id it saw; the result has one per vocabulary entry."""
    width = 2 if vocab_size <= 65536 else 4

    def run(batches):
        total = np.zeros(vocab_size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"), minlength=vocab_size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "count"])

    rows = tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    counts = np.zeros(vocab_size, np.int64)
    for r in rows:
        counts[r["id"]] = r["count"]
    return counts


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (package-merge); 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(leaves))
        merged = merged[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as canonical Huffman codes are."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each max_bits bits ahead: id * 32 + length of the code they begin with."""
    out = np.zeros(1 << max_bits, np.uint32)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths):
        rest = max_bits - int(lengths[i])
        out[int(codes[i]) << rest : (int(codes[i]) + 1) << rest] = i * 32 + int(lengths[i])
    return out


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code bits of documents, each from a whole byte on: bytes, first byte of each document (and the end), bit offset of each segment."""
    size = lengths[ids].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    bits = np.concatenate([[0], np.cumsum(size)])
    doc_bytes = (bits[starts[1:]] - bits[starts[:-1]] + 7) // 8
    first = np.concatenate([[0], np.cumsum(doc_bytes)])
    at = bits[:-1] + np.repeat(first[:-1] * 8 - bits[starts[:-1]], counts)
    segments = (counts + step - 1) // step
    seg_doc = np.repeat(np.arange(len(counts)), segments)
    seg_no = np.arange(len(seg_doc)) - np.repeat(np.cumsum(segments) - segments, segments)
    offsets = at[starts[seg_doc] + seg_no * step] if len(ids) else np.zeros(0, np.int64)
    words = np.zeros(int(first[-1]) // 4 + 3, np.uint64)
    if len(ids):
        value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        cut = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[cut]] += np.add.reduceat(value >> np.uint64(32), cut)
        words[word[cut] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), cut)
    return words.astype(">u4").view(np.uint8)[: int(first[-1])], first, offsets


def unpack(payload: bytes, counts: np.ndarray, offsets: np.ndarray, decode: np.ndarray, step: int = STEP, max_bits: int = MAX_BITS) -> np.ndarray:
    """The ids of a block: every segment moves on by one id at a time, all in one array operation."""
    counts = counts.astype(np.int64)
    segments = (counts + step - 1) // step
    sizes = np.full(int(segments.sum()), step, np.int64)
    ends = np.cumsum(segments)
    some = segments > 0
    sizes[ends[some] - 1] = counts[some] - (segments[some] - 1) * step
    out = np.zeros(int(counts.sum()), np.uint32)
    place = np.cumsum(sizes) - sizes
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint64)
    # the 40 bits from each byte on, so that a code starts in the first of five bytes
    ahead = raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]
    order = np.argsort(-sizes, kind="stable")
    at, place, sizes = offsets.astype(np.int64)[order], place[order], sizes[order]
    mask, live = np.uint64((1 << max_bits) - 1), len(sizes)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        here = at[:live]
        entry = decode[(ahead[here >> 3] >> (40 - max_bits - (here & 7)).astype(np.uint64)) & mask]
        out[place[:live] + k] = entry >> 5
        here += entry & 31
    return out


def write_blocks(tokens: DataFrame, lengths: np.ndarray, path: str, total: int) -> None:
    """Encode, place by doc_id range and pack. Range bounds are quantiles of doc_id: they shape files, not results."""
    spark = tokens.sparkSession
    width = 2 if len(lengths) <= 65536 else 4
    shards = max(1, -(-total // SHARD_IDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK_IDS))))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))  # no id: first
    bounds = sorted(int(x) for x in tokens.select(place.alias("place")).approxQuantile("place", [k / shards for k in range(1, shards)], 0.1 / shards)) if shards > 1 else []

    def code(batches):
        codes = canonical_codes(lengths)
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.int64)
            for s in _runs(n):
                counts = n[s]
                ids = np.frombuffer(b"".join(batch.column(2)[s.start : s.stop].to_pylist()), f"<u{width}")
                raw, first, offsets = pack(ids, counts, lengths, codes)
                raw = raw.tobytes()
                segs = np.concatenate([[0], np.cumsum((counts + STEP - 1) // STEP)])
                shift = np.repeat(first[:-1] * 8, np.diff(segs))
                rel = (offsets - shift).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array(counts), pa.array([rel[4 * a : 4 * b] for a, b in zip(segs, segs[1:])], pa.binary()), pa.array([raw[a:b] for a, b in zip(first, first[1:])], pa.binary())], ["doc_id", "n", "offsets", "bits"])

    def blocks(batches):
        shard, block, before, held, size = None, 0, 0, [], 0

        def row():
            counts = [h[1] for h in held]
            base = np.concatenate([[0], np.cumsum([len(h[3]) for h in held])])[:-1] * 8
            offsets = np.concatenate([np.frombuffer(h[2], "<u4").astype("<u8") + b for h, b in zip(held, base.astype("<u8"))])
            payload = b"".join(h[3] for h in held)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": before, "doc_ids": [h[0] for h in held], "counts": counts, "offsets": offsets.astype("<u8").tobytes(), "payload": payload, "payload_crc32": zlib.crc32(payload)}], schema=BLOCK_ARROW)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (values[0] != shard or size >= BLOCK_IDS):
                    yield row()
                    before, block, held, size = (before + size, block + 1, [], 0) if values[0] == shard else (0, 0, [], 0)
                shard = values[0]
                held.append(values[1:])
                size += values[2]
        if held:
            yield row()

    coded = tokens.mapInArrow(code, "doc_id long, n long, offsets binary, bits binary")
    shard = F.lit(0)
    if bounds:
        upto = lambda test: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), test))
        below, at_most = upto(lambda b: b < place), upto(lambda b: b <= place)
        # a bound that stands several times is an id (or none) of very many documents: these are dealt to as many shards
        shard = F.when(at_most > below + 1, below + 1 + F.pmod(F.monotonically_increasing_id(), at_most - below)).otherwise(at_most)
    placed = coded.select(shard.cast("int").alias("shard"), "doc_id", "n", "offsets", "bits")
    placed = placed.repartitionById(len(bounds) + 1, F.col("shard")) if bounds else placed.coalesce(1)
    placed.sortWithinPartitions("shard", "doc_id", "n").mapInArrow(blocks, BLOCK_SQL).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame(pa.table({"id": pa.array(np.flatnonzero(lengths), pa.int64()), "bits": pa.array(lengths[lengths > 0].astype(np.int32))}).to_pandas(), "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")


def _runs(n: np.ndarray, limit: int = 1 << 19) -> Iterator[slice]:
    """Runs of documents of about so many ids."""
    at = size = 0
    for k, x in enumerate(n):
        size += int(x)
        if size >= limit:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(n):
        yield slice(at, len(n))


BLOCK_SQL = "shard int, block int, first long, doc_ids array<long>, counts array<long>, offsets binary, payload binary, payload_crc32 long"
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.binary()), ("payload", pa.binary()), ("payload_crc32", pa.int64())])


def read_blocks(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files; ids as little-endian unsigned 32-bit numbers, or only their crc32."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per vocabulary entry at most
    lengths = np.zeros(max([0, *(r["id"] for r in book)]) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(BLOCK_SQL).parquet(f"{path}/blocks")
    # one row per shard (SHARD_IDS ids), summed where they lie; a running sum gives where each shard starts
    shards = blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids")).collect()
    starts, at = {}, 0
    for r in sorted(shards, key=lambda r: r["shard"]):
        starts[r["shard"]] = at
        at += r["ids"]

    def run(batches):
        decode = decoding_table(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["payload_crc32"]:
                    raise ValueError(f"block {r['shard']}/{r['block']} is damaged")
                counts = np.array(r["counts"], np.int64)
                ids = unpack(r["payload"], counts, np.frombuffer(r["offsets"], "<u8"), decode).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * (b - c) : 4 * b] for b, c in zip(ends.tolist(), counts.tolist())]
                values = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends - counts + r["first"] + starts[r["shard"]]), pa.array(counts), values], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def write_token_ids(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = None) -> None:
    """Encode all documents (doc_id, text) with the tokenizer and write the block files."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(tokenizer_json).get_vocab().values()) + 1
    tokens = written(tokenise(docs, tokenizer_json, end_id), "token-ids")
    counts = id_counts(tokens, size)
    write_blocks(tokens, code_lengths(counts), path, int(counts.sum()))
    dropped(tokens)


def op1_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = new_path(spark, "op1")
    write_token_ids(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_json, end_id=1)
    return read_blocks(spark, path, digest=True)
