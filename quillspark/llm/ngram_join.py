r"""N-gram Jaccard join (op 5): documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Exact, without all pairs, in these steps (n is a set's size; a "class" is all documents of one set, named by its least doc_id):

1  One pass over the texts hashes shingles (64 bits) and writes, per document, n, a digest of the set, HASHES minimum hashes, the
   counts of its shingles by GROUPS hash groups (a point), and the parities of such counts over finer groups, two per element or more.
   Equal digests form classes.
2  Classes with a minimum hash in common are linked through one of them: one verified pair per class, not per pair. It is the one whose
   minimum hashes most classes have, as the text that others were made from does, whatever its id.
   This joins most copies of a group to one component, found by label propagation over written tables, so that step 3 needs only
   look for links between components.
3  Count-vector R-trees. Two sets that link share one of the first n - ceil(0.75 n) + 1 shingles in any one order of all shingles, so
   classes are dealt to the shingles of that prefix (often found ones come last in the order, so shared passages rarely come up);
   shingles with several components are kept, each with the classes' vectors. A shingle's classes of up to FEW are one leaf
   of a tree, whose entries are held against each other directly. More are dealt in cells by their sizes' logarithm and, beyond BLOCK, a
   hash; cells whose sizes can link meet, and an R-tree over the points of one is searched with those of the other: the sum of
   coordinate minima bounds the overlap of a point with all below a node. Entries that meet must also pass the bound of the finer
   vectors (first of a few bytes of them, which travel with the classes): each group of unlike parity holds an element that one side
   lacks. A pair is given once, at its first common shingle. What is left is verified on whole sets: three pairs of two components
   first, the others where these don't join them.

Nothing about all documents reaches the driver but at most OFTEN shingle hashes, which only shape the order.

Defined results: null, empty or wordless text has an empty set, which is linked with nothing (n_shingles 0, component its own id);
repeated rows have equal sets, so one class; blank rows that share an id with a text link nothing; an id that stands on several texts, and rows without id, take part as rows of their own, so
links by way of them hold (the component of a row without id is that of what it links with, null if that has no id at all); a very
long text is hashed in pieces, its set is held whole; of equal minimum hashes and sizes the least id goes first; an empty table
gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, splitmix, table, written
from .units import slices

WORDS, PERCENT = 5, 75
HASHES, GROUPS, FINE = 6, 128, 2
#: Shingles put last in the order, at most; and in how many documents of a batch one must be to count as often found.
OFTEN, OFTEN_IN_BATCH = 1 << 18, 4
#: Classes of a block, entries of an R-tree node, classes of a shingle that pair directly, and mixed shingles up to which
#: their table is broadcast (16 bytes each); ids to verify up to which theirs is (8 bytes each).
BLOCK, FANOUT, FEW, BROADCAST_KEYS, BROADCAST_IDS = 1024, 16, 48, 2_000_000, 1_000_000
#: Into how many parts the classes of a minimum hash are dealt when they meet its centre; bytes of a text hashed at a time; bytes of the
#: parities that go with a class to each shingle of its prefix (folded, as a class has as many of these as it has elements); shared shingles of
#: a class that go with it to each of them, at most (pairs of classes with more come once per shingle, and are made one later).
SALTS, PIECE, CARRIED, CARRIED_KEYS = 16, 1 << 22, 32, 64

_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_letter = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def _piece_hashes(raw: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[True], white]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letter[raw] * _powers(BASE, len(raw)), dtype=np.uint64)])
    return splitmix((sums[end] - sums[start]) * _powers(BASE_INVERSE, len(raw) + 1)[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts (A-Z lower-cased), and where each text's words begin (and the end)."""
    raws = [t.encode() for t in texts]
    raw = _lower[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    white = _white[raw]
    found, at = [], 0
    while at < len(raw):  # pieces end with white space, so no word is cut
        to = min(at + PIECE, len(raw))
        while to < len(raw) and not white[to - 1]:
            ahead = np.flatnonzero(white[to : to + PIECE])
            to = to + int(ahead[0]) + 1 if len(ahead) else min(to + PIECE, len(raw))
        hashes, start = _piece_hashes(raw[at:to], white[at:to])
        found.append((hashes, start + at))
        at = to
    hashes, start = (np.concatenate(x) for x in zip(*found))
    texts_at = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return hashes, np.searchsorted(start, texts_at)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes; fewer words than a shingle has count as one shingle."""
    h, at = word_hashes(texts)
    if len(h) >= words:
        rows = np.full(len(h) - words + 1, words, np.uint64)
        for k in range(words):
            rows = splitmix(rows * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - words + 1 + k])
    else:
        rows = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rows[a : b - words + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = splitmix(one * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(one)
        else:
            out.append(rows[:0])
    return out


def enough(both, a, b):
    """Whether two sets of a and b elements, `both` of them shared, link. Empty sets link with nothing."""
    return (both > 0) & (100 * both >= PERCENT * (a + b - both))


_salts = splitmix(np.arange(11, 11 + HASHES, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
DESCRIBED = "doc_id long, n long, digest binary, hashes array<long>, point binary, fine binary, sketch binary, often array<long>"


def point(x: np.ndarray) -> bytes:
    """Elements by group; 65535 stands for any number from there on."""
    return np.minimum(np.bincount(x & np.uint64(GROUPS - 1), minlength=GROUPS), 65535).astype("<u2").tobytes()


def points_of(raw: list[bytes]) -> np.ndarray:
    out = np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), GROUPS).astype(np.int64)
    out[out == 65535] = 1 << 40
    return out


def fine_point(x: np.ndarray) -> bytes:
    """Whether a group has an odd number of elements; a power of two of groups, FINE per element or more, from 64 on."""
    groups = max(64, 1 << (FINE * len(x) - 1).bit_length())
    return np.packbits(np.bincount(x & np.uint64(groups - 1), minlength=groups).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(a: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities over fewer groups, which are the last bits of the hashes."""
    while a.shape[-1] > width:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def may_link(a: np.ndarray, b: np.ndarray, n, m):
    """Whether sets of n and m elements with these parities can share enough; each group of unlike parity has one that a side lacks."""
    width = min(a.shape[-1], b.shape[-1])
    unlike = np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum(axis=-1, dtype=np.int64)
    return enough((n + m - unlike) // 2, n, m)


def carried(fine: bytes) -> bytes:
    return _folded(np.frombuffer(fine, np.uint64), CARRIED // 8).tobytes()


class FinePoints:
    """Finer points of many sets, by width."""

    def __init__(self, raw: pa.Array):
        data = raw.to_pylist()
        self.width = np.array([len(x) // 8 for x in data], np.int64)
        self.row, self.matrix = np.zeros(len(data), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.matrix[w] = np.frombuffer(b"".join([data[k] for k in at.tolist()]), np.uint64).reshape(len(at), w)

    def left(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each pair of entries i and j whether they may share enough."""
        out, w, v = np.zeros(len(i), bool), self.width[i], self.width[j]
        for x, y in set(zip(w.tolist(), v.tolist())):
            at = np.flatnonzero((w == x) & (v == y))
            for part in np.array_split(at, 1 + len(at) * max(x, y) // (1 << 20)):
                p, q = i[part], j[part]
                out[part] = may_link(self.matrix[x][self.row[p]], self.matrix[y][self.row[q]], n[p], n[q])
        return out


def describe(docs: DataFrame) -> DataFrame:
    """Step 1. Besides a row per document, rows with n = -1 hold shingles often found in a batch."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 21):
                sets = shingle_sets(texts.to_pylist())
                keys = batch.column(0).slice(at, len(texts)).to_pylist()
                n = [len(x) for x in sets]
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                least = [[int(v) for v in np.array([splitmix(x ^ k).min() for k in _salts]).view(np.int64)] if len(x) else None for x in sets]
                points, fine = [point(x) if len(x) else None for x in sets], [fine_point(x) if len(x) else None for x in sets]
                # of equal sets one counts, else long copies alone would fill what is put last
                once = {d: x for d, x in zip(digests, sets) if d is not None}
                values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *once.values()]), return_counts=True)
                often = values[counts >= OFTEN_IN_BATCH].view(np.int64)
                often = [None] * len(keys) + [often]
                yield pa.RecordBatch.from_arrays([pa.array([*keys, None], pa.int64()), pa.array([*n, -1], pa.int64()), pa.array([*digests, None], pa.binary()), pa.array([*least, None], pa.list_(pa.int64())), pa.array([*points, None], pa.binary()), pa.array([*fine, None], pa.binary()), pa.array([*(None if x is None else carried(x) for x in fine), None], pa.binary()), pa.array(often, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "hashes", "point", "fine", "sketch", "often"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DESCRIBED)


def prefixes(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """(doc_id, prefix): the first n - ceil(0.75 n) + 1 shingles, those in `last` (sorted) after all others."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 21):
                out = []
                for x in shingle_sets(texts.to_pylist()):
                    p = len(x) + (-PERCENT * len(x) // 100) + 1 if len(x) else 0
                    if p and len(last):
                        is_last = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                        x = np.concatenate([x[~is_last], x[is_last]])
                    out.append(x[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(out, pa.list_(pa.int64()))], names=["rep", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rep long, prefix array<long>").where("size(prefix) > 0")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, n, elements) of the documents named by ids (rep), from their whole texts; blank rows, which may have the id of another text, have no set."""

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 21):
                sets = shingle_sets(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "n", "elements"])

    ids = written(ids.select("rep").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi")
    return named.mapInArrow(run, "rep long, n long, elements binary").where("n > 0")


def verified(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of pairs (a, b) that link, by their whole sets."""
    pairs = written(pairs.select("a", "b").distinct(), f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    sets = written(sets_of(docs, ids), f"{name}-sets")  # rows of one id have one set

    def run(batches):
        for batch in batches:
            keep = [enough(len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)), len(x.as_buffer()) // 8, len(y.as_buffer()) // 8) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(list(batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).columns), names=["a", "b"])

    first = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    links = written(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), f"{name}-links")
    dropped(pairs, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(rep, label): label is the least class reachable over links (a, b). Only classes with a link have a row.

    Each round takes the least label among neighbours, then that label's own label, so paths shorten fast; rounds are written tables.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("rep"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["rep"] == near["a"]).select("rep", F.least("label", "near").alias("hop"), F.col("label").alias("was"))
        jump = labels.select(F.col("rep").alias("hop"), F.col("label").alias("far"))
        step = written(step.join(jump, "hop", "left").select("rep", F.least("hop", F.coalesce("far", "hop")).alias("label"), "was"), "labels")
        dropped(labels)
        labels = step.select("rep", "label")
        if step.where("label <> was").isEmpty():
            dropped(edges)
            return labels


class RTree:
    """Points (counts per group) packed in blocks of FANOUT entries, level upon level; each node keeps its entries' greatest counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.lexsort((np.argmax(points, axis=1), sizes))
        self.levels = [(order, None, None, None)]
        inner = order
        maxima, lo, hi = points[order], sizes[order], sizes[order]
        while len(inner) > FANOUT:
            cut = np.arange(0, len(maxima), FANOUT)
            maxima, lo, hi = np.maximum.reduceat(maxima, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((None, maxima, lo, hi))
            inner = cut

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Entries that may share enough with a set of this point: summed minima bound what any set below a node can share."""
        need = lambda other: np.ceil(PERCENT * (size + other) / (100 + PERCENT))
        live = None
        for _, maxima, lo, hi in reversed(self.levels[1:]):
            at = np.arange(len(maxima)) if live is None else live[live < len(maxima)]
            fits = (100 * hi[at] >= PERCENT * size) & (100 * size >= PERCENT * lo[at])
            at = at[fits]
            at = at[np.minimum(maxima[at], point).sum(axis=1) >= need(np.maximum(lo[at], PERCENT * size / 100))]
            live = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        order = self.levels[0][0]
        at = order if live is None else order[live[live < len(order)]]
        return at[np.minimum(self.points[at], point).sum(axis=1) >= need(self.sizes[at])]


PAIR, PAIRS = ("a", "b", "la", "lb"), "a long, b long, la long, lb long"


def sides(rep: np.ndarray, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows (a, b, la, lb): the pair's classes, the one of the lesser label first, and their labels."""
    turn = label[i] > label[j]
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    return np.stack([rep[i], rep[j], label[i], label[j]], axis=1)


def few_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of other labels that may link among the classes of each key; keys have FEW members (key, rep, n, label, sketch) at most."""

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        key, rep, n, label = (t.column(c).to_numpy() for c in ("key", "rep", "n", "label"))
        fine, found = FinePoints(t.column("sketch")), [np.zeros((0, 4), np.int64)]
        for lag in range(1, min(FEW, len(key))):
            same = key[:-lag] == key[lag:]
            if not same.any():
                break
            i = np.flatnonzero(same & (label[:-lag] != label[lag:]) & (100 * n[:-lag] >= PERCENT * n[lag:]))
            i = i[fine.left(i, i + lag, n)]
            found.append(sides(rep, label, i, i + lag))
        found = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], names=PAIR)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                yield pairs_of(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows = sum(x.num_rows for x in held)
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return members.select("key", "rep", "n", "label", "sketch").repartition("key").sortWithinPartitions("key", "n", "rep").mapInArrow(run, PAIRS).distinct()


def first_common(key: int, keys: list, q: int, found: np.ndarray) -> np.ndarray:
    """Whether key is the first that entry q and each of found have in common; also if either's keys aren't known."""
    out = np.ones(len(found), bool)
    some = np.array([k for k, f in enumerate(found.tolist()) if keys[f] is not None], np.int64)
    if keys[q] is None or not len(some):
        return out
    lists = [keys[f] for f in found[some].tolist()]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate(lists)
    # keys are sorted: before this one there must be none of q's
    before = np.isin(flat, keys[q]) & (flat < key)
    out[some] = np.add.reduceat(before, np.cumsum(lengths) - lengths) == 0
    return out


def many_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The same for keys of any number of members, by R-trees over cells: a size class (sizes that differ by a third) and a hash.

    A cell's number of hashes follows from partial counts, so no task sees all classes of a key.
    """
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int"))
    counts = members.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    counts = written(counts, "cells")
    near = F.broadcast(counts) if counts.count() <= BROADCAST_IDS else counts
    # each class's shared shingles, if they aren't too many to go along: a pair is given at the first that it has in common
    shared = members.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("keys")).select("rep", F.when(F.size("keys") <= CARRIED_KEYS, F.col("keys")).alias("keys"))
    members = written(members.join(near, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).join(classes.select("rep", "point", "fine"), "rep").join(shared, "rep").select("key", "band", "part", "rep", "n", "label", "point", "fine", "keys"), "cell-members")
    cells = members.groupBy("key", "band", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"))
    right = cells.alias("r")
    # sizes that link are of the same band, the next or (by rounding, at most) the one after
    ahead = cells.select("*", F.explode(F.sequence("band", F.col("band") + 2)).alias("to")).alias("l")
    meet = ahead.join(right, F.expr(f"l.key = r.key AND l.to = r.band AND (l.band < r.band OR l.part <= r.part) AND 100 * l.hi >= {PERCENT} * r.lo AND least(l.first, r.first) <> greatest(l.last, r.last)"))
    meet = written(meet.select("l.key", F.struct("l.band", "l.part").alias("i"), F.struct("r.band", "r.part").alias("j")), "meetings")
    columns = ["rep", "n", "label", "point", "fine", "keys"]
    cell = F.struct("band", "part")
    placed = members.select("key", cell.alias("cell"), *columns)
    from_i = meet.join(placed.withColumnRenamed("cell", "i"), ["key", "i"]).select("key", "i", "j", F.lit(0).alias("side"), *columns)
    from_j = meet.where("i <> j").join(placed.withColumnRenamed("cell", "j"), ["key", "j"]).select("key", "i", "j", F.lit(1).alias("side"), *columns)

    def run(t):
        rep, n, label, side = (t.column(c).to_numpy() for c in ("rep", "n", "label", "side"))
        points, fine = points_of(t.column("point").to_pylist()), FinePoints(t.column("fine"))
        inside, outside = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        tree, key = RTree(points[inside], n[inside]), t.column("key")[0].as_py()
        keys = [None if x is None else np.array(x, np.int64) for x in t.column("keys").to_pylist()]
        pairs = [np.zeros((0, 4), np.int64)]
        for q in inside if same else outside:
            found = inside[tree.search(points[q], n[q])]
            found = found[label[found] != label[q]]
            found = found[rep[found] < rep[q]] if same else found
            found = found[fine.left(found, np.full(len(found), q), n)]
            found = found[first_common(key, keys, int(q), found)]
            pairs.append(sides(rep, label, found, np.full(len(found), q)))
        return pa.table({c: np.concatenate(pairs)[:, k] for k, c in enumerate(PAIR)})

    return from_i.union(from_j).groupBy("key", "i", "j").applyInArrow(run, PAIRS).distinct()


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that the classes' whole finer vectors leave."""

    def run(batches):
        for batch in batches:
            n, m, f, g = (batch.column(c) for c in ("n", "m", "f", "g"))
            keep = [bool(may_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), i, j)) for x, y, i, j in zip(f, g, n.to_pylist(), m.to_pylist())]
            yield batch.select(list(PAIR)).filter(pa.array(keep, pa.bool_()))

    first = classes.select(F.col("rep").alias("a"), "n", F.col("fine").alias("f"))
    second = classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("fine").alias("g"))
    return pairs.join(first, "a").join(second, "b").select(*PAIR, "n", "m", "f", "g").mapInArrow(run, PAIRS)


def salt():
    """A hash may have very many classes: they meet copies of what goes with it (salted()) in SALTS tasks."""
    return F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _own_ids(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(doc_id, own, text) where rows without id and those of ids with several sets have an id of their own; None if there are no such rows."""
    clash = rows.where("n > 0").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("doc_id IS NULL OR lo <> hi")
    clash = written(clash.select("doc_id", F.lit(True).alias("clash")), "clashing")
    n = clash.count()
    if n == 0:
        return None
    clash = F.broadcast(clash) if n <= BROADCAST_IDS else clash
    both = docs.alias("d").join(clash.alias("c"), F.expr("d.doc_id <=> c.doc_id"), "left").select("d.doc_id", "d.text", "c.clash")
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    # numbers of rows are below (partitions + 1) << 33, far from the ends unless ids lie there; then they go below the least
    own = F.lit(0 if most is None else most + 1) + number if most is None or most < 1 << 62 else F.lit(least - 1) - number
    return written(both.select("doc_id", F.when(F.col("clash"), own).otherwise(F.col("doc_id")).alias("own"), "text"), "own-ids")


def is_blank(text="text"):
    """Whether a text has no words."""
    return ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = written(describe(docs), "described")
    rows = written(described.where("n >= 0").select("doc_id", "n", "digest"), "rows")
    own = _own_ids(docs, rows)
    if own is None:
        return _linked(docs, described, rows)
    renamed = own.select(F.col("own").alias("doc_id"), "text")
    described = written(describe(renamed), "described")
    rows = written(described.where("n >= 0").select("doc_id", "n", "digest"), "rows")
    found = written(_linked(renamed, described, rows), "found")
    named = found.withColumnRenamed("doc_id", "own").join(own.select("own", "doc_id").distinct(), "own")
    named = written(named, "named")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component_id").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _linked(docs: DataFrame, described: DataFrame, rows: DataFrame) -> DataFrame:
    """linked() where each id has one set, and every row with a set has an id."""
    often = described.where("n < 0").select(F.explode("often").alias("key")).groupBy("key").count().orderBy(F.desc("count"), "key").limit(OFTEN)
    last = np.sort(often.select("key").toArrow().column("key").to_numpy().view(np.uint64))  # OFTEN at most
    # of each set the least id; its columns follow by id, so wide rows are not aggregated
    least = written(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "least")
    wide = described.where("n > 0").select(F.col("doc_id").alias("rep"), "digest", "n", "hashes", "point", "fine", "sketch")
    classes = written(wide.join(least.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "classes")
    dropped(described, least)

    # step 2: first one hash for all, then the others between what is still apart
    hashes = classes.select("rep", F.posexplode("hashes").alias("k", "h"))
    shared = salted(hashes.groupBy("k", "h").agg(F.count("*").alias("classes")).where("classes > 1"))
    common = hashes.withColumn("salt", salt()).join(shared, ["k", "h", "salt"]).groupBy("rep").agg(F.sum("classes").alias("common"))
    hashed = written(classes.select("rep", "n", "hashes").join(common, "rep", "left").withColumn("common", F.coalesce("common", F.lit(0))), "hashed")

    def stars(labels: DataFrame, first: int, to: int, tries: int) -> DataFrame:
        known = hashed.select("rep", "n", "common", F.explode(F.transform(F.slice("hashes", first + 1, to - first), lambda h, k: F.struct(k.alias("k"), h.alias("h")))).alias("x")).select("rep", "n", "common", "x.*").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        centre = F.min(F.struct((-F.col("common")).alias("rare"), "label", "rep", "n")).alias("c")
        centres = salted(known.groupBy("k", "h").agg(centre, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k", "h", "c"))
        pairs = known.withColumn("salt", salt()).join(centres, ["k", "h", "salt"]).where("label <> c.label AND 100 * least(n, c.n) >= 75 * greatest(n, c.n)").select(F.col("c.rep").alias("a"), F.col("rep").alias("b"), F.col("c.label").alias("to"), "label")
        apart = pairs.groupBy("to", "label").agg(F.slice(F.array_sort(F.collect_set(F.struct("a", "b"))), 1, tries).alias("p")) if to - first > 1 else None
        return pairs if apart is None else apart.select(F.explode("p").alias("p")).select("p.a", "p.b")

    none = docs.sparkSession.createDataFrame([], "rep long, label long")
    links = verified(docs, stars(none, 0, 1, 1), "stars")
    labels = links.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("rep"), "label")
    links = written(links.union(verified(docs, stars(labels, 1, HASHES, 3), "more-stars")), "links")
    labels = components(links)

    # step 3
    info = written(classes.join(labels, "rep", "left").select("rep", "n", F.coalesce("label", "rep").alias("label"), "sketch"), "info")
    firsts = written(prefixes(docs, last).join(info.select("rep", "label"), "rep").dropDuplicates(["rep"]), "prefixes")
    keys = firsts.select(F.explode("prefix").alias("key"), "rep", "label")
    mixed = written(keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", (F.col("size") <= FEW).alias("few")), "mixed")
    mixed = F.broadcast(mixed) if mixed.count() <= BROADCAST_KEYS else mixed
    # narrow rows first: only what has a mixed key gets its vector
    members = written(keys.select("key", "rep").join(mixed, "key").join(info, "rep").select("key", "rep", "n", "label", "few", "sketch"), "members")
    dropped(firsts)
    some = bounded(few_pairs(members.where("few")), classes)
    pairs = written(some.union(many_pairs(members.where("NOT few").select("key", "rep", "n", "label"), classes)).distinct(), "candidates")
    dropped(members)
    # two components may meet in very many pairs: three are tried, and others only where these don't join them
    tries = [F.min(F.struct("a", "b")), F.max(F.struct("a", "b")), F.min(F.struct(F.xxhash64("a", "b").alias("x"), "a", "b"))]
    tries = pairs.groupBy("la", "lb").agg(F.array(*[F.struct(t["a"].alias("a"), t["b"].alias("b")) for t in tries]).alias("p"))
    links = written(links.union(verified(docs, tries.select(F.explode("p").alias("p")).select("p.a", "p.b"), "tried")), "links")
    labels = components(links)
    of = labels.select(F.col("rep").alias("a"), F.col("label").alias("x"))
    apart = pairs.join(of, "a", "left").join(of.withColumnsRenamed({"a": "b", "x": "y"}), "b", "left").where("coalesce(x, a) <> coalesce(y, b)")
    links = links.union(verified(docs, apart, "rest"))
    dropped(pairs)
    labels = components(links)

    known = classes.select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(known, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents", "doc_id", "text"))
