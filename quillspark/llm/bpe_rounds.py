"""BPE encoding and decoding (op 11) in batched numpy merge rounds, as the tokenizers library codes byte-level BPE.

The symbols of many words lie in one flat array. In a round each word's pairs of neighbours are looked up by binary search among the sorted
pair keys, and every word contracts its pair of lowest rank wherever it stands (from the left, where it overlaps itself). Words
without a pair are done and leave the array. One round may take all places of a pair because a pair that holds a merged symbol ranks
behind the merge that makes the symbol; a file in which that isn't so contracts one place per word and round.

Texts are cut into chunks and matches as in op 4, whose memos and windows for long matches are used here too; the library's own splitter cuts what
isn't ASCII, so that its version of Unicode decides. Special tokens are found as the library finds them: in the text as it stands, before it
is cut. Decoding puts the bytes of each id one after the other.

Defined results: null text is the empty text (0 tokens, digests of no bytes); a very long text is coded in pieces, a very long match in
windows, with memory in proportion to the text; of equal pairs the leftmost goes first; repeated rows are kept; an empty table gives
no rows; extra columns aren't read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import MEMO_BYTES, SLICE, ByteBpe
from .common import held, table
from .units import Memo, bytes_of, gathered, slices, strings

#: No pair of the table.
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """How byte-level files write bytes: those that show as they are, all others as the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class PairTable:
    """Merges by sorted pair keys: rank and merged id of a pair."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.width = max(vocabulary.values(), default=0) + 1
        left, right = (np.array([vocabulary[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys, first = np.unique((left * self.width + right)[::-1], return_index=True)
        self.rank = len(merges) - 1 - first  # of equal pairs the last counts
        self.keys, self.made = keys, made[self.rank]
        born = np.full(self.width, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        again = len(np.unique(made)) < len(made)
        #: Whether a pair that holds a merged symbol always ranks behind that symbol's merge.
        self.in_order = not again and bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NONE) if len(self.keys) else np.full(len(wanted), NONE)


def merged(pairs: PairTable, token: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pos, token) of words whose symbols lie one after the other, in order; pos counts the symbols at the outset."""
    made = np.zeros(len(pairs.rank), np.int64)
    made[np.argsort(np.argsort(pairs.rank))] = pairs.made  # by place among the ranks
    order = np.sort(pairs.rank)
    word = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rank = np.full(len(token), NONE)
    if len(token) > 1:
        rank[:-1] = np.where(word[1:] == word[:-1], pairs.ranks(token[:-1], token[1:]), NONE)
    done = []
    while len(token):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(begin, len(token)))
        least = np.minimum.reduceat(rank, begin)
        over = np.repeat(least == NONE, size)
        if over.any():
            done.append((word[over], pos[over], token[over]))
            word, pos, token, rank = (x[~over] for x in (word, pos, token, rank))
            size, least = size[least != NONE], least[least != NONE]
            if not len(token):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        if pairs.in_order:  # where a pair overlaps itself, every other place of the run
            begins = np.append(True, np.diff(hit) != 1)
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        else:
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
        token[hit] = made[np.searchsorted(order, rank[hit])]
        keep = np.ones(len(token), bool)
        keep[hit + 1] = False
        at = np.cumsum(keep)[hit] - 1
        word, pos, token, rank = (x[keep] for x in (word, pos, token, rank))
        near = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[near] = NONE
        near = near[near < len(token) - 1]
        near = near[word[near] == word[near + 1]]
        rank[near] = pairs.ranks(token[near], token[near + 1])
    if not done:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    word, pos, token = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")  # a word leaves in one piece
    return word[order], pos[order], token[order]


class RoundsBpe(ByteBpe):
    """ByteBpe with numpy rounds in place of queries, over a tokenizer's file."""

    def __init__(self, tokenizer_json: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import pre_tokenizers

        spec = json.loads(tokenizer_json)
        model, splitter, decoder = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (plain and spec["normalizer"] is None and splitter.get("type") == decoder.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")):
            raise ValueError("only plain byte-level BPE without a normalizer can be coded")
        added = spec.get("added_tokens", [])
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added) or any(c.isspace() for x in added for c in x["content"]):
            raise ValueError("special tokens with white space, or that take some, can't be coded")
        vocabulary = model["vocab"]
        self.pairs = PairTable(vocabulary, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        letters = byte_letters()
        self.byte = np.array([vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.special = {x["content"]: x["id"] for x in added}
        raw = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in self.special.items()}
        sizes = np.array([len(raw.get(i, b"")) for i in range(max(raw) + 1)], np.int64)
        self.spelled, self.sizes, self.starts = np.frombuffer(b"".join(raw.get(i, b"") for i in range(len(sizes))), np.uint8), sizes, np.cumsum(sizes) - sizes
        ascii_matches, library = regex.compile(PATTERN).findall, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

        def find(text: str) -> list[str]:
            out = []
            for part in cut(text):
                if part in self.special:
                    out.append(part)
                elif part:
                    out += ascii_matches(part) if part.isascii() else [part[a:b] for _, (a, b) in library.pre_tokenize_str(part)]
            return out

        self.find = find
        self.matches, self.chunks = Memo(MEMO_BYTES, np.uint32, np.uint8), Memo(MEMO_BYTES, np.uint32, np.uint8)

    def _contracted(self, words: pa.Array) -> pa.Table:
        raw, at = bytes_of(words)
        return pa.table(dict(zip(("word", "pos", "token"), merged(self.pairs, self.byte[raw], np.diff(at)))))

    def _decoded(self, coded: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        token = coded.column("token").to_numpy()
        return gathered(self.spelled, self.starts[token], self.sizes[token]), np.bincount(coded.column("word").to_numpy(), self.sizes[token], minlength=n).astype(np.int64)

    def _code(self, words: pa.Array) -> list:
        special = pc.is_in(words, value_set=pa.array(list(self.special), words.type)).to_numpy(zero_copy_only=False)
        if not special.any():
            return super()._code(words)
        (ids, n), (raw, m) = super()._code(words.filter(pa.array(~special)))
        ids, raw = np.split(ids, np.cumsum(n)[:-1]), np.split(raw, np.cumsum(m)[:-1])
        rest = iter(zip(ids, raw))
        both = [(np.array([self.special[w]], np.int64), np.frombuffer(w.encode(), np.uint8)) if s else next(rest) for w, s in zip(words.to_pylist(), special)]
        return [(np.concatenate(x), np.array([len(y) for y in x], np.int64)) for x in zip(*both)]


def encode_documents(docs: DataFrame, tokenizer_json: str, keep: list[str] | None = None) -> DataFrame:
    """docs (with doc_id, text) -> doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (UTF-8), and further columns to keep."""
    keep = keep or []
    key = ("rounds", hash(tokenizer_json))
    schema = docs.select("doc_id", *keep).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")

    def run(batches):
        bpe = held(key, lambda: RoundsBpe(tokenizer_json))
        for batch in batches:
            for at, texts in slices(batch.column(batch.num_columns - 1), SLICE):
                (ids, n), (raw, m) = bpe.encode(texts)
                columns = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                both = [x.cast(pa.large_string()).view(pa.large_binary()).cast(pa.binary()) for x in (strings(ids.astype("<u4").view(np.uint8), 4 * n), strings(raw, m))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), *both], names=schema.fieldNames())

    return docs.select("doc_id", *keep, "text").mapInArrow(run, schema)


def op11_bpe_rounds(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        coded = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), f.read())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
