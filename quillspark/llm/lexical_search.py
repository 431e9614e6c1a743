"""Ranked lexical search (op 13): a threshold-seeded join of items with documents.

Documents are tokenised once; of each is kept its number of terms and its bag, the item terms that it holds with their counts. Documents of equal
number and bag score equally for every item, so they are one class, with its number of copies. Then

1. each term gets, over all documents, its weight, its greatest impact and its kth impact (by copies), and these are stored as a table;
2. an item has k documents with at least its greatest kth impact, so that bounds its kth score from below. The classes that hold
   kth impacts or better are scored exactly (seeds); the kth of their scores is a better bound;
3. an item's terms are sorted by their greatest impacts; those whose sum stays below the bound are pruned, since a document with no
   other term can't reach it. Classes that hold another term are candidates. A candidate whose sum over those terms and the pruned terms'
   greatest impacts stays below the bound goes; all others are rescored exactly over all terms;
4. the best k classes of an item, by score and least id, hold its best k documents; of each class the k least ids are taken.

A bound is compared with "below" only, so ties at the kth place are kept and settled by id. All scores are sums of whole numbers.
Items go in blocks of ITEM_BYTES of text, each against all documents, so what the driver and the workers hold of them is bounded. All work on
documents is per row of Arrow batches; what is shuffled of a term or an item is k rows a batch at most.

Defined results: null and empty texts, and texts without a term, have no terms, aren't counted in N and score nothing; a very long text is
held whole, several times over as numbers, and is one document; equal scores go by ascending doc_id, null ids last; repeated rows are documents of their own; of
repeated items one is ranked, items of one id with different texts are ranked each, a null item_id is an id; an item without a
term, or whose terms no document holds, has no rows; empty tables give no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written
from .units import bytes_of, gathered, slices, strings

#: Bytes of item texts in a block, and of document texts that are tokenised at a time.
ITEM_BYTES, SLICE = 16 << 20, 1 << 22
#: Bytes of terms' bags that are looked through at a time.
BAGS = 1 << 20
#: Documents per item. Fixed by the query's contract.
K = 20

#: Bytes of terms: digits, letters, and all of other characters (fixed by the query's contract).
_in_term = np.zeros(256, bool)
_in_term[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and how many each text has."""
    raw, at = bytes_of(texts)
    inside = _in_term[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    own = at[:-1][(at[:-1] < len(raw)) & (np.diff(at) > 0)]
    begins[own] = inside[own]  # terms don't span texts
    start = np.flatnonzero(begins)
    upto = np.concatenate([[0], np.cumsum(inside)])
    lengths = np.diff(np.append(upto[start], upto[-1]))
    return strings(_lower[raw[inside]], lengths), np.diff(np.searchsorted(start, at))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


def tokenised(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n, bag (the vocabulary's terms in it: pairs of place and count, 32-bit), cls (digest of n and bag)."""
    schema = docs.select("doc_id").schema.add("n", "long").add("bag", "binary").add("cls", "binary")
    width = max(1, len(vocabulary))

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE):
                terms, n = terms_of(texts)
                place = pc.index_in(terms, value_set=vocabulary.cast(terms.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(texts)), n)[place >= 0]
                key, tf = summed(row * width + place[place >= 0], np.ones(len(row), np.int64))
                flat = np.stack([key % width, tf], axis=1).astype("<i4")
                cut = np.searchsorted(key // width, np.arange(len(texts) + 1))
                bags = [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                cls = [hashlib.md5(b"%d:" % k + b).digest() for k, b in zip(n.tolist(), bags)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(bags, pa.binary()), pa.array(cls, pa.binary())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bags(batches):
    """Parts of the batches with few enough bytes of bags: (n, copies, cls, row of each term, place, count)."""
    for whole in batches:
        for at, bags in slices(whole.column("bag").cast(pa.large_binary()).view(pa.large_string()), BAGS):
            batch = whole.slice(at, len(bags))
            raw, ends = bytes_of(bags)
            pairs = raw.view("<i4").reshape(-1, 2).astype(np.int64)
            yield batch.column("n").to_numpy(), batch.column("copies").to_numpy(), batch.column("cls"), np.repeat(np.arange(len(bags)), np.diff(ends) // 8), pairs[:, 0], pairs[:, 1]


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, texts: int, total: int) -> np.ndarray:
    """The contract's score of one occurrence in the item; texts is N, total is L."""
    m = 100 - 25 + (25 * n * texts) // max(total, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def frequencies(classes: DataFrame) -> DataFrame:
    """(place, df)"""

    def run(batches):
        for _, copies, _, row, place, _ in _bags(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in summed(place, copies[row])], names=["place", "df"])

    return classes.mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))


def _kth(rows: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """(key, kth, top): the greatest score, and the greatest that k copies have at least (0 if there are fewer)."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc())
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)  # cut before the shuffle
    rows = rows.withColumn("so_far", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col(score))), F.lit(0)).alias("kth"), F.max(score).alias("top"))


class Block:
    """Items that go together, with all that a worker needs of them. Places are of the sorted vocabulary of their terms."""

    def __init__(self, rows: list, k: int):
        self.items, self.k = rows, k
        terms, n = terms_of(pa.array([r["text"] or "" for r in rows], pa.large_string()))
        coded = terms.dictionary_encode()
        order = np.argsort(np.array(coded.dictionary.to_pylist(), object)) if len(coded.dictionary) else np.zeros(0, np.int64)
        self.vocabulary = coded.dictionary.take(pa.array(order))
        place = np.argsort(order)[coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
        width = max(1, len(order))
        key, self.times = summed(np.repeat(np.arange(len(rows)), n) * width + place, np.ones(len(place), np.int64))
        self.item, self.place = key // width, key % width  # one per item and term, by item

    def by_place(self, some: np.ndarray):
        """For look-ups: of the chosen entries, those of each place lie together."""
        order = some[np.argsort(self.place[some], kind="stable")]
        first = np.searchsorted(self.place[order], np.arange(len(self.vocabulary) + 1))
        return self.item[order], self.times[order], first

    def set_weights(self, df: dict[int, int], texts: int, total: int) -> None:
        self.texts, self.total = texts, total
        self.df = np.array([df.get(p, 0) for p in range(len(self.vocabulary))], np.int64)
        self.weight = np.floor(1000 * np.log((2 * texts + 2) / (2 * self.df + 1))).astype(np.int64)

    def scored(self, row, place, impact, lookup):
        """(row * items + item, sum of the item's terms in lookup)"""
        item, times, first = lookup
        size = first[place + 1] - first[place]
        at = gathered(np.arange(len(item)), first[place], size)
        return summed(np.repeat(row, size) * len(self.items) + item[at], np.repeat(impact, size) * times[at])

    def rescored(self, pairs: np.ndarray, row, place, impact) -> np.ndarray:
        """The exact scores of pairs (row * items + item, in order)."""
        rows, wanted = np.unique(pairs // len(self.items)), pairs
        of = np.isin(row, rows)
        key, score = self.scored(row[of], place[of], impact[of], self.by_place(np.arange(len(self.item))))
        at = np.searchsorted(key, wanted)
        return np.where((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == wanted), score[np.minimum(at, len(key) - 1)], 0)


def term_table(classes: DataFrame, block: Block) -> DataFrame:
    """(place, kth, top) of each term over all classes."""

    def run(batches):
        for n, copies, _, row, place, tf in _bags(batches):
            impact = impacts(block.weight[place], tf, n[row], block.texts, block.total)
            order = np.lexsort((-impact, place))
            place, impact, copies = place[order], impact[order], copies[row][order]
            begins = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
            nth = np.arange(len(place)) - np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0)) if len(place) else place
            few = nth < block.k
            yield pa.RecordBatch.from_arrays([pa.array(x[few], pa.int64()) for x in (place, impact, copies)], names=["place", "impact", "copies"])

    found = classes.mapInArrow(run, "place long, impact long, copies long").groupBy("place", "impact").agg(F.sum("copies").alias("copies"))
    return _kth(found, "place", "impact", block.k)


def seeds(classes: DataFrame, block: Block, kth: np.ndarray) -> DataFrame:
    """(item, score, copies): exact scores of classes with an impact of kth or better, for the items that have the term."""

    def run(batches):
        lookup = block.by_place(np.arange(len(block.item)))
        for n, copies, _, row, place, tf in _bags(batches):
            impact = impacts(block.weight[place], tf, n[row], block.texts, block.total)
            good = np.flatnonzero((impact >= kth[place]) & (impact > 0))
            order = good[np.lexsort((-impact[good], place[good]))]
            begins = np.append(True, place[order[1:]] != place[order[:-1]]) if len(order) else np.zeros(0, bool)
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)) if len(order) else order
            some = order[nth < block.k]  # any classes give a bound that holds; these are enough for a good one
            pairs, _ = block.scored(row[some], place[some], impact[some], lookup)
            score = block.rescored(pairs, row, place, impact)
            at, item = np.divmod(pairs, len(block.items))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, score, copies[at])], names=["item", "score", "copies"])

    return classes.mapInArrow(run, "item long, score long, copies long")


def essential(block: Block, bound: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries (item and term) that make candidates, and per item the sum of the pruned terms' greatest impacts."""
    most = top[block.place] * block.times
    order = np.lexsort((most, block.item))
    sums = np.cumsum(most[order])
    first = np.searchsorted(block.item[order], np.arange(len(block.items)))
    before = np.concatenate([[0], sums])[first]
    pruned = sums - before[block.item[order]] < bound[block.item[order]]
    rest = np.zeros(len(block.items), np.int64)
    np.add.at(rest, block.item[order][pruned], most[order][pruned])
    return order[~pruned], rest


def candidates(classes: DataFrame, block: Block, bound: np.ndarray, top: np.ndarray) -> DataFrame:
    """(item, cls, least, score): exact scores of all classes that reach the items' bounds."""
    chosen, rest = essential(block, bound, top)

    def run(batches):
        lookup, width = block.by_place(chosen), len(block.items)
        for batch in batches:
            at = 0
            for n, _, cls, row, place, tf in _bags([batch]):
                impact = impacts(block.weight[place], tf, n[row], block.texts, block.total)
                pairs, part = block.scored(row, place, impact, lookup)
                item = pairs % width
                pairs = pairs[part + rest[item] >= np.maximum(bound[item], 1)]
                score = block.rescored(pairs, row, place, impact)
                keep = score >= np.maximum(bound[pairs % width], 1)
                rows = pa.array(pairs[keep] // width)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[keep] % width, pa.int64()), cls.take(rows), batch.column("least").slice(at, len(n)).take(rows), pa.array(score[keep], pa.int64())], names=["item", "cls", "least", "score"])
                at += len(n)

    schema = classes.select(F.lit(0).cast("long").alias("item"), "cls", "least", F.lit(0).cast("long").alias("score")).schema
    return classes.mapInArrow(run, schema)


def _block_hits(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    own = written(tokenised(docs, block.vocabulary), "bags")
    texts, total = own.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = written(own.where(F.octet_length("bag") > 0).groupBy("cls", "n", "bag").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "classes")
    block.set_weights({r["place"]: r["df"] for r in frequencies(classes).collect()}, texts, total)  # a block's terms
    stored = written(term_table(classes, block), "terms")
    kth, top = np.zeros((2, len(block.vocabulary)), np.int64)
    for r in stored.collect():  # a block's terms
        kth[r["place"]], top[r["place"]] = r["kth"], r["top"]
    bound = np.zeros(len(block.items), np.int64)
    np.maximum.at(bound, block.item, kth[block.place] * block.times)
    for r in _kth(seeds(classes, block, kth), "item", "score", k).collect():  # a block's items
        bound[r["item"]] = max(bound[r["item"]], r["kth"])

    ids = F.asc_nulls_last("least")
    best = Window.partitionBy("item").orderBy(F.desc("score"), ids, "cls")
    hits = written(candidates(classes, block, bound, top).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth"), "hits")
    of_class = Window.partitionBy("cls").orderBy(F.asc_nulls_last("doc_id"))
    named = own.join(hits.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id").withColumn("nth", F.row_number().over(of_class)).where(F.col("nth") <= k)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = hits.select("item", "cls", "score").join(named, "cls").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(block.items)), pa.int64()), "item_id": pa.array([r["item_id"] for r in block.items], pa.int64())}))
    out = written(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    dropped(own, classes, hits)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks, found = max(1, -(-2 * size // item_bytes)) if size > item_bytes else 1, None
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for at in range(blocks):
        rows = items.where(part == at).orderBy("item_id", "text").collect()  # about item_bytes
        if rows:
            hits = _block_hits(docs.select("doc_id", "text"), Block(rows, k), k)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select(F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).where("false")
    return found


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE = r"""
WITH asked AS (SELECT DISTINCT item_id, text FROM benchmark),
words AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
wanted AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked),
lengths AS (SELECT rid, doc_id, count(*) AS n FROM words GROUP BY 1, 2),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
counts AS (SELECT rid, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY 1) CROSS JOIN stats),
impacts AS (SELECT c.rid, l.doc_id, c.term, w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (100 - 25 + (25 * l.n * s.docs) // s.total))) AS impact
    FROM counts c JOIN lengths l USING (rid) JOIN weights w USING (term) CROSS JOIN stats s),
scores AS (SELECT q.item_id, q.text, i.rid, i.doc_id, sum(i.impact * q.times)::BIGINT AS score FROM (SELECT item_id, text, term, count(*) AS times FROM wanted GROUP BY 1, 2, 3) q JOIN impacts i USING (term) GROUP BY 1, 2, 3, 4)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
