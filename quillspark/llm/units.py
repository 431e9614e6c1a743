"""What the tokenising operators share: whole texts as one array of bytes, cut into units, and a memo of what units map to.

All of it is Arrow and numpy, so a unit costs its bytes and not Python objects, and a memo's bound is one of bytes. A memo only saves
work: whatever it forgets is learned again, with the same result.

Defined results: null text is the empty text and has no unit; a very long text is a slice of its own, held once or twice over as
bytes; equal units map to equal values; no texts give no units.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about so many bytes, nulls as empty, each with the place of its first text."""
    column = column.fill_null("")
    upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield at, column.slice(at, to - at)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins (and the end)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_safe_cut = re.compile(rb"[a-zA-Z](?= [a-zA-Z])").search


def pieces(texts: pa.Array, limit: int) -> tuple[pa.Array, np.ndarray]:
    """Texts of more than limit bytes in pieces of about that, cut before single spaces between letters; and each piece's text.

    Neither a word nor a match of a token pattern spans such a place, so the pieces' ids one after the other are the text's.
    """
    raw, at = bytes_of(texts)
    if not (np.diff(at) > 2 * limit).any():
        return texts, np.arange(len(texts))
    data, lengths, owner = raw.tobytes(), [], []
    for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
        while b - a > 2 * limit and (m := _safe_cut(data, a + limit, b)):
            lengths.append(m.end() - a)
            owner.append(k)
            a = m.end()
        lengths.append(b - a)
        owner.append(k)
    return strings(raw, np.array(lengths)), np.array(owner)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Neighbouring pieces of UTF-8 bytes as an array."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    if ends[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def gathered(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(start - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Runs:
    """Runs of numbers, one per entry, in one array."""

    def __init__(self, dtype):
        self.flat, self.start, self.length, self.used, self.entries = np.zeros(1024, dtype), np.zeros(256, np.int64), np.zeros(256, np.int32), 0, 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, size = self.entries, self.entries + len(lengths)
        if size > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(size, x.dtype)]) for x in (self.start, self.length))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(flat), self.flat.dtype)])
        self.length[n:size] = lengths
        self.start[n:size] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.used, self.entries = self.used + len(flat), size

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these entries, one after the other, and their lengths."""
        lengths = self.length[at].astype(np.int64)
        return gathered(self.flat, self.start[at], lengths), lengths

    def bytes(self) -> int:
        return self.flat.nbytes + self.start.nbytes + self.length.nbytes


class Memo:
    """Units and the runs of numbers they map to. Beyond `limit` bytes it keeps units met in more than one slice, if they are at most half."""

    def __init__(self, limit: int, *dtypes):
        self.limit, self.dtypes = limit, dtypes
        self.clear()

    def clear(self) -> None:
        self.keys, self.runs, self.uses = pa.array([], pa.large_string()), [Runs(t) for t in self.dtypes], np.zeros(256, np.int32)

    def bytes(self) -> int:
        return self.keys.nbytes + self.uses.nbytes + sum(r.bytes() for r in self.runs)

    def forget(self) -> None:
        keep = np.flatnonzero(self.uses[: len(self.keys)] > 1)
        keys, runs, half = self.keys, self.runs, self.limit // 2
        self.clear()
        kept = keys.take(pa.array(keep))
        found = [r.of(keep) for r in runs]
        if kept.nbytes + sum(flat.nbytes + 12 * len(lengths) for flat, lengths in found) <= half:
            self._add(kept, found)

    def _add(self, keys: pa.Array, found: list) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        for r, (flat, lengths) in zip(self.runs, found):
            r.add(flat, lengths)
        if len(self.keys) > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(len(self.keys), np.int32)])

    def find(self, units: pa.Array, learn: Callable[[pa.Array], list]) -> np.ndarray:
        """The entry of each unit. learn gets the unknown ones, each once, and gives a pair (flat, lengths) for each kind of run."""
        if self.bytes() > self.limit:
            self.forget()
        coded = units.cast(pa.large_string()).dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            found = learn(fresh)
            at[new] = len(self.keys) + np.arange(len(new))
            self._add(fresh, found)
        self.uses[at] += 1
        return at[coded.indices.to_numpy(zero_copy_only=False)]
