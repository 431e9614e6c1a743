"""Byte-level BPE encoding and decoding (op 4) as DuckDB recursive queries, one DuckDB per worker.

Token-position rows (word, position, token) join the merge table (left, right -> token); each step contracts, in every
word, the leftmost pair of least rank, until no pair is left. Decoding is an ordered aggregation of the tokens' bytes.

Words repeat, so the queries run over each worker's distinct new words only; memos of bounded bytes keep their ids and bytes.
A text is cut before each single space that stands between two characters that aren't white space. There the pattern always
starts a new match (one of its ` ?` forms takes the space), so cutting there never changes a match.

A match of more than LONG bytes would take a step per contraction over all of it. It goes through the query as overlapping windows, which
are joined where both have the same token at the same place. The result is the match's own coding: a run of tokens is what its bytes
are coded as if and only if each two neighbours are (the first contraction across a border of tokens would be the least pair among
these two as well), and each two neighbours of the joined run are neighbours in a window. Where windows have no
such place others are tried, and at last all of the match so far is coded as one.

Defined results: null text is the empty text (0 tokens, digests of no bytes); a very long text is coded in pieces cut as above, a
very long match in windows, with memory in proportion to the text; of pairs of equal rank the leftmost goes first; repeated rows are
kept; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table
from .units import Memo, bytes_of, pieces, slices, strings

#: Bytes of a worker's memos of chunks and of matches, and of texts that are coded at a time.
MEMO_BYTES, SLICE = 64 << 20, 1 << 22
#: Bytes of words that one recursive query takes (or one word).
QUERY_BYTES = 1 << 18
#: Matches of more bytes go in windows of WINDOW bytes, one every STRIDE bytes; windows tried anew where two don't meet.
LONG, WINDOW, STRIDE, TRIES = 256, 128, 64, 8

ENCODE = """
WITH RECURSIVE steps(word, pos, after, token, next, settled) AS (
    SELECT word, pos, after, token, next, false FROM positions
    UNION ALL
    (WITH ranked AS MATERIALIZED (
        SELECT s.word, s.pos, s.after, s.token, s.next, m.token AS merged
        FROM steps s LEFT JOIN merges m ON m.l = s.token AND m.r = s.next
        WHERE NOT s.settled
     ), best AS MATERIALIZED (
        SELECT word, min((merged << 32) | pos) AS best, arg_min(after, (merged << 32) | pos) AS gone
        FROM ranked GROUP BY word
     ), cut AS (
        SELECT b.word, b.best & 4294967295 AS hit, b.best >> 32 AS merged, b.gone, g.after, g.next
        FROM best b LEFT JOIN ranked g ON g.word = b.word AND g.pos = b.gone
     )
     SELECT r.word, r.pos,
            CASE WHEN r.pos = c.hit THEN c.after ELSE r.after END,
            CASE WHEN r.pos = c.hit THEN c.merged ELSE r.token END,
            CASE WHEN r.pos = c.hit THEN c.next WHEN r.after = c.hit THEN c.merged ELSE r.next END,
            c.hit IS NULL
     FROM ranked r JOIN cut c ON c.word = r.word
     WHERE c.hit IS NULL OR r.pos <> c.gone)
)
SELECT word, pos, token FROM steps WHERE settled ORDER BY word, pos
"""

DECODE = """
SELECT word, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (token)
GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token: its rank is its id."""
    rows = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("l", "r", "token"), zip(*rows))})


def _is_white(raw: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character that ends before `at`, or that begins there, is white space (in UTF-8)."""
    k = [np.clip(at + j, 0, len(raw) - 1) for j in ((-3, -2, -1) if before else (0, 1, 2))]
    x, y, z = (raw[i] for i in k)
    one, (p, q) = (z, (y, z)) if before else (x, (x, y))
    three = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    return (one == 32) | ((one >= 9) & (one <= 13)) | ((one >= 28) & (one <= 31)) | ((p == 0xC2) & ((q == 0x85) | (q == 0xA0))) | three


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts in order, and how many each text has."""
    raw, at = bytes_of(texts)
    cut = np.flatnonzero(raw == 32)
    begins = np.zeros(len(raw) + 1, bool)
    begins[at] = True
    cut = cut[(cut > 0) & (cut < len(raw) - 1)]
    cut = cut[~begins[cut] & ~begins[cut + 1]]
    cut = cut[~_is_white(raw, cut, True) & ~_is_white(raw, cut + 1, False)]
    begins[cut] = True
    start = np.flatnonzero(begins[: len(raw)])
    return strings(raw, np.diff(np.append(start, len(raw)))), np.diff(np.searchsorted(start, at))


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.con = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '300MB'", "temp_directory = ''"):  # nothing is spilled
            self.con.execute(f"SET {setting}")
        for name, rows in (("merges_in", merge_table(ranks)), ("vocabulary_in", pa.table({"token": pa.array(ranks.values(), pa.int64()), "hex": [t.hex() for t in ranks]}))):
            self.con.register(name, rows)
            self.con.execute(f"CREATE TABLE {name[:-3]} AS SELECT * FROM {name}")
            self.con.unregister(name)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Matches of the pattern, and chunks of texts: ids and the bytes they decode to.
        self.matches, self.chunks = Memo(MEMO_BYTES, np.uint32, np.uint8), Memo(MEMO_BYTES, np.uint32, np.uint8)

    def _query(self, sql: str, **rows: pa.Table) -> pa.Table:
        for name, x in rows.items():
            self.con.register(name, x)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            for name in rows:
                self.con.unregister(name)

    def _contracted(self, words: pa.Array) -> pa.Table:
        """(word, pos, token) in order; pos counts bytes. One recursive query."""
        raw, at = bytes_of(words)
        lengths, tokens = np.diff(at), self.byte[raw]
        pos = np.arange(len(tokens)) - np.repeat(at[:-1], lengths)
        last = np.zeros(len(tokens), bool)
        last[at[1:] - 1] = True
        return self._query(ENCODE, positions=pa.table({"word": np.repeat(np.arange(len(words)), lengths), "pos": pos, "after": pa.array(pos + 1, mask=last), "token": tokens, "next": pa.array(np.append(tokens[1:], 0), mask=last)}))

    def _decoded(self, coded: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of n words' tokens; one ordered aggregation."""
        back = pa.concat_arrays([x.cast(pa.binary()) for x in self._query(DECODE, tokens=coded).column("bytes").chunks])
        raw, at = bytes_of(back.view(pa.string()))
        assert len(back) == n
        return raw, np.diff(at)

    def _code(self, words: pa.Array) -> list:
        """Ids of words and the bytes they decode to, each as (flat, lengths)."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if (sizes > LONG).any():
            return self._code_long(words, sizes)
        ids, n, raw, m = [], [], [], []
        at, upto = 0, np.cumsum(sizes)
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + QUERY_BYTES, "right")))
            got = self._contracted(words.slice(at, to - at))
            ids.append(got.column("token").to_numpy())
            n.append(np.bincount(got.column("word").to_numpy(), minlength=to - at))
            back, lengths = self._decoded(got, to - at)
            raw.append(back)
            m.append(lengths)
            at = to
        return [(np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *n])), (np.concatenate([np.zeros(0, np.uint8), *raw]), np.concatenate([np.zeros(0, np.int64), *m]))]

    def _code_long(self, words: pa.Array, sizes: np.ndarray) -> list:
        short = np.flatnonzero(sizes <= LONG)
        (ids, n), (raw, m) = self._code(words.take(pa.array(short)))
        ids, raw = dict(zip(short.tolist(), np.split(ids, np.cumsum(n)[:-1]))), dict(zip(short.tolist(), np.split(raw, np.cumsum(m)[:-1])))
        for k in np.flatnonzero(sizes > LONG).tolist():
            ids[k] = self._joined(words[k].as_py().encode())
            coded = pa.table({"word": np.zeros(len(ids[k]), np.int64), "pos": np.arange(len(ids[k])), "token": ids[k]})
            raw[k] = self._decoded(coded, 1)[0]
        return [(np.concatenate([x[k] for k in range(len(words))]), np.array([len(x[k]) for k in range(len(words))])) for x in (ids, raw)]

    def _windows(self, word: bytes, spans: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
        """Per span of the word its tokens and where in the word each begins; equal windows are coded once."""
        distinct = {w: k for k, w in enumerate(dict.fromkeys(word[a:b] for a, b in spans))}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        group: list[bytes] = []

        def code():
            data = np.frombuffer(b"".join(group), np.uint8)
            got = self._contracted(strings(data, np.array([len(w) for w in group])))
            cut = np.searchsorted(got.column("word").to_numpy(), np.arange(1, len(group)))
            found.extend(zip(np.split(got.column("pos").to_numpy(), cut), np.split(got.column("token").to_numpy(), cut)))
            group.clear()

        for w in distinct:
            if group and sum(map(len, group)) + len(w) > QUERY_BYTES:
                code()
            group.append(w)
        code()
        return [((found[k := distinct[word[a:b]]][1]).tolist(), (found[k][0] + a).tolist()) for a, b in spans]

    def _joined(self, word: bytes) -> np.ndarray:
        spans = [(a, min(a + WINDOW, len(word))) for a in range(0, max(1, len(word) - WINDOW + STRIDE), STRIDE)]
        coded = self._windows(word, spans)
        tokens, begins = list(coded[0][0]), list(coded[0][1])
        again: dict[bytes, tuple[list[int], list[int]]] = {}

        def meet(a, more, at) -> bool:
            """Go on with a window's tokens from the last place at or after a where both have the same token."""
            place, k = dict(zip(at, range(len(at)))), len(tokens) - 1
            while k >= 0 and begins[k] >= a:
                if (j := place.get(begins[k])) is not None and more[j] == tokens[k]:
                    tokens[k:], begins[k:] = more[j:], at[j:]
                    return True
                k -= 1
            return False

        for (a, b), (more, at) in zip(spans[1:], coded[1:]):
            if meet(a, more, at):
                continue
            # windows that begin where a token does (in texts that repeat, the others may never fall in step)
            for p in begins[: -TRIES - 1 : -1]:
                if (w := word[p:b]) not in again:
                    more, at = self._windows(w, [(0, len(w))])[0]
                    again[w] = more, at
                more, at = again[w]
                if meet(p, more, [x + p for x in at]):
                    break
            else:
                tokens, begins = self._windows(word, [(0, b)])[0]
        return np.array(tokens, np.int64)

    def _learn_chunks(self, chunks: pa.Array) -> list:
        found = [self.find(c) for c in chunks.to_pylist()]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = self.matches.find(pa.array([m for ms in found for m in ms], pa.large_string()), self._code)
        ends = np.cumsum(n)
        out = []
        for runs in self.matches.runs:
            flat, lengths = runs.of(at)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            out.append((flat, upto[ends] - upto[ends - n]))
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """All ids in one array, and how many each text has; the same of the bytes that they decode to."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts, owner = pieces(texts, SLICE)
        out = [([np.zeros(0, dtype)], np.zeros(len(texts), np.int64)) for dtype in (np.uint32, np.uint8)]
        for at, some in slices(parts, SLICE):
            chunks, counts = chunks_of(some)
            entries = self.chunks.find(chunks, self._learn_chunks)
            upto = np.cumsum([0, *counts])
            for (found, total), runs in zip(out, self.chunks.runs):
                flat, lengths = runs.of(entries)
                found.append(flat)
                np.add.at(total, owner[at : at + len(some)], np.diff(np.concatenate([[0], np.cumsum(lengths)])[upto]))
        return [(np.concatenate(found), total) for found, total in out]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None) -> DataFrame:
    """docs (with doc_id, text) and their ids and decoded bytes as binary columns `ids` and `decoded`; n_tokens counts the ids.

    keep: further columns of docs to hand on.
    """
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
    key = ("bpe", hash((lines, pattern)))
    keep = keep or []
    schema = docs.select("doc_id", *keep).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")

    def run(batches):
        bpe = held(key, lambda: ByteBpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.split(b"\n"))}, pattern))
        for batch in batches:
            for at, texts in slices(batch.column(batch.num_columns - 1), SLICE):
                (ids, n), (raw, m) = bpe.encode(texts)
                coded, decoded = strings(ids.astype("<u4").view(np.uint8), 4 * n), strings(raw, m)
                columns = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), *(x.view(pa.large_binary() if pa.types.is_large_string(x.type) else pa.binary()).cast(pa.binary()) for x in (coded, decoded))], names=schema.fieldNames())

    return docs.select("doc_id", *keep, "text").mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = encode_documents(docs, read_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


