"""Interval overlap join (op 12) by offline dominance counting: a sweep by start over Fenwick trees of end ranks.

Both sides are whole-numbered slots, both ends included; FAR is the end of what is open. Of the left intervals ("queries") each distinct
(key, start, end) is asked once; right intervals ("points") of one key, start and end are one point with its number and sum of crcs. Nine
relations tell how a query lies to a point that shares a slot with it; each needs the number of its points, their crcs and the slots shared.

With S, E of the query and s, e of a point: points that live at S (s <= S <= e) are found by the sweep, told apart by s < S or s = S and by
e <, =, > E as ranges of end ranks. Points that begin later follow from sums along one axis: those that end before E without those that
end before S or live at S; those that end at E; those that begin by E and don't end by E. Each is a sum of what is found at S and at E, so
a query is two events, and their sums are added up.

Keys are cut into blocks of WIDTH slots. A block gets its events, the points that begin or end in it, points carried in (begun before,
ending in it or later, summed by end) and the sums of all earlier blocks (`base`). So the rows of one key, however many, lie in as many groups as
it has blocks, and a group has as many points and queries as there are distinct ends for WIDTH starts. What meets in one window per key is one row per block. A point is carried into
each block that it spans; open ones are in `base` instead.

Sessions are cut in the same way: clicks become one row per client and half hour (a gap between two clicks of one half hour never is over
30 minutes), rows of a day become runs, and only a day's first and last runs, which alone may go on over midnight, meet per client.

Defined results: rows without client, or without sold_at or ts, are ignored; lines without shipped_at or sale count nothing; repeated clicks are one
click; each row of sales is a sale, so repeated rows give repeated results; a sale without id has no lines; a session whose clicks at its last ts differ
in kind is open if one is an error; null kind and null status aren't open; ties of slots are relations of their own; a sale with no session gives no
row; empty tables give no rows; other columns aren't read, whatever their names. Text isn't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: The end of an open interval, in slots.
FAR = 1 << 40
#: Slots of a block; rows that a task gathers before it counts the whole blocks among them.
WIDTH, ROWS = 16, 1 << 18
#: A longer pause between clicks begins a session; the length of a slot; in microseconds. Fixed by the query's contract.
PAUSE, SLOT = 30 * 60 * 1_000_000, 6 * 3600 * 1_000_000
DAY = 86_400_000_000
#: Fixed by the query's contract: the query begins earlier, equally, later; and ends earlier, equally, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
OVERLAPS, FINISHED_BY, CONTAINS, STARTS, EQUALS, STARTED_BY, DURING, FINISHES, OVERLAPPED_BY = range(9)

#: Earlier blocks' points by start and by end, and open ones; points carried in, that begin, that end; queries that begin, that end.
BEGUN, ENDED, OPENED, CARRIED, BEGINS, ENDS, FROM, TO = range(8)
#: Key, block, kind, start, end, number, sum of starts, sum of ends, sum of crcs.
ROW = "key long, block long, kind int, s long, e long, n long, ss long, se long, crc long"
FIELDS = [f.split()[0] for f in ROW.split(", ")]
SUMS = ("n", "ss", "se", "crc")
FOUND = "key long, s long, e long, relation int, n long, slots long, crc long"


class Fenwick:
    """One tree per group, all in flat arrays; updates and prefix sums of many groups at once. Values have several columns."""

    def __init__(self, sizes: np.ndarray, columns: int):
        self.size = sizes
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.sums = np.zeros((int((sizes + 1).sum()), columns), np.int64)

    def add(self, group: np.ndarray, rank: np.ndarray, values: np.ndarray) -> None:
        """rank from 0"""
        at = rank + 1
        while len(at):
            np.add.at(self.sums, self.base[group] + at, values)
            at = at + (at & -at)
            keep = at <= self.size[group]
            group, at, values = group[keep], at[keep], values[keep]

    def upto(self, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sums of all ranks below."""
        out, base, at = np.zeros((len(rank), self.sums.shape[1]), np.int64), self.base[group], rank.copy()
        while at.any():
            out += self.sums[base + at]  # the place of rank 0 is always zero
            at &= at - 1
        return out


def _ranks(group: np.ndarray, end: np.ndarray, known: np.ndarray, first: np.ndarray, side: str) -> np.ndarray:
    """How many of the group's known ends (sorted codes) lie before an end, or at most at it."""
    return np.searchsorted(known, group * (FAR << 1) + end, side) - first[group]


def _running(group: np.ndarray, slot: np.ndarray, values: np.ndarray, base: np.ndarray):
    """f(group, slot, side): base of the group, and the values at slots below (left) or up to (right) that one."""
    code = group * (FAR << 1) + slot
    order = np.argsort(code, kind="stable")
    code, sums = code[order], np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values[order], axis=0)])

    def upto(g, x, side):
        return base[g] + sums[np.searchsorted(code, g * (FAR << 1) + x, side)] - sums[np.searchsorted(code, g * (FAR << 1), "left")]

    return upto


def counted(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What whole blocks find for their events, as rows of FOUND. Rows are sorted by key and block."""
    key, block, kind = rows["key"], rows["block"], rows["kind"]
    fresh = np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]))
    group, groups = np.cumsum(fresh) - 1, int(fresh.sum())
    low = block[fresh] * WIDTH
    pick = lambda *kinds: np.flatnonzero(np.isin(kind, kinds))
    col = lambda at, *names: np.stack([rows[c][at] for c in names], axis=1)

    def earlier(of):
        at, out = pick(of), np.zeros((groups, 4), np.int64)
        out[group[at]] = col(at, *SUMS)
        return out

    begins, ends, carried = pick(BEGINS), pick(ENDS), pick(CARRIED)
    by_start = _running(group[begins], rows["s"][begins], col(begins, *SUMS), earlier(BEGUN))
    by_end = _running(group[ends], rows["e"][ends], col(ends, *SUMS), earlier(ENDED))

    # the trees: ranks of all ends that a group's points have
    everyone = np.arange(groups)
    code = np.unique(np.concatenate([group[begins] * (FAR << 1) + rows["e"][begins], group[carried] * (FAR << 1) + rows["e"][carried], everyone * (FAR << 1) + FAR]))
    first = np.searchsorted(code, everyone * (FAR << 1))
    size = np.diff(np.append(first, len(code)))
    tree = Fenwick(size, 4)
    tree.add(everyone, size - 1, earlier(OPENED))
    tree.add(group[carried], _ranks(group[carried], rows["e"][carried], code, first, "left"), col(carried, *SUMS))

    asks = pick(FROM)
    g, s, e = group[asks], rows["s"][asks], rows["e"][asks]
    cuts = [_ranks(g, x, code, first, side) for x, side in ((s, "left"), (e, "left"), (e, "right"))] + [size[g]]
    before, after = np.zeros((3, len(asks), 4), np.int64), np.zeros((3, len(asks), 4), np.int64)

    def ranges(out, of):
        sums = [tree.upto(g[of], c[of]) for c in cuts]
        for k in range(3):
            out[k, of] = sums[k + 1] - sums[k]

    point_at, ask_at = rows["s"][begins] - low[group[begins]], s - low[g]
    for step in range(WIDTH):
        own, new = np.flatnonzero(ask_at == step), begins[point_at == step]
        if len(own):
            ranges(before, own)
        tree.add(group[new], _ranks(group[new], rows["e"][new], code, first, "left"), col(new, *SUMS))
        if len(own):
            ranges(after, own)
    after -= before

    out = []
    finite = np.where(e == FAR, 0, e)  # slots shared with an open query count where the point isn't open

    def give(who, relation, n, slots, crc):
        some = np.flatnonzero((n != 0) | (crc != 0) | (slots != 0))
        out.append((key[who][some], rows["s"][who][some], rows["e"][who][some], np.full(len(some), relation, np.int32), n[some], slots[some], crc[some]))

    def until_point(x):  # sum of e - s + 1
        return x[:, 2] - x[:, 1] + x[:, 0]

    both = before + after
    for found, kinds in ((before, (OVERLAPPED_BY, FINISHES, DURING)), (after, (STARTED_BY, EQUALS, STARTS))):
        for k, x in enumerate(found):
            give(asks, kinds[k], x[:, 0], x[:, 2] - x[:, 0] * (s - 1) if k == 0 else np.where(e == FAR, 0, x[:, 0] * (finite - s + 1)), x[:, 3])
    gone = by_end(g, s, "left") + both[0]
    give(asks, CONTAINS, -gone[:, 0], -until_point(gone), -gone[:, 3])
    for k, relation in ((1, FINISHED_BY), (2, OVERLAPS)):
        give(asks, relation, -both[k][:, 0], np.where(e == FAR, 0, both[k][:, 1] - both[k][:, 0] * (finite + 1)), -both[k][:, 3])

    asks = pick(TO)
    g, e = group[asks], rows["e"][asks]
    finite = np.where(e == FAR, 0, e)
    ended, ended_by, begun = by_end(g, e, "left"), by_end(g, e, "right"), by_start(g, e, "right")
    give(asks, CONTAINS, ended[:, 0], until_point(ended), ended[:, 3])
    for relation, n, ss, crc in ((FINISHED_BY, *((ended_by - ended)[:, k] for k in (0, 1, 3))), (OVERLAPS, *((begun - ended_by)[:, k] for k in (0, 1, 3)))):
        give(asks, relation, n, np.where(e == FAR, 0, n * (finite + 1) - ss), crc)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=[f.split()[0] for f in FOUND.split(", ")])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows in runs of whole blocks, of about ROWS rows."""
    kept: list[pa.RecordBatch] = []

    def columns(some):
        t = pa.Table.from_batches(some)
        return {c: t.column(c).to_numpy() for c in FIELDS}

    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        if sum(x.num_rows for x in kept) < ROWS:
            continue
        rows = columns(kept)
        last = np.flatnonzero((rows["key"] != rows["key"][-1]) | (rows["block"] != rows["block"][-1]))
        if not len(last):
            continue
        cut = int(last[-1]) + 1
        yield {c: x[:cut] for c, x in rows.items()}
        kept = [pa.RecordBatch.from_arrays([pa.array(rows[c][cut:]) for c in FIELDS], schema=b.schema)]
    if kept:
        yield columns(kept)


def _count(batches):
    for rows in _whole_blocks(batches):
        yield counted(rows)


def floor_div(x: Column, by: int) -> Column:
    """Of whole numbers, exactly, rounding down."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def _block(slot: str) -> Column:
    return floor_div(F.col(slot), WIDTH)


def relations(queries: DataFrame, points: DataFrame) -> DataFrame:
    """queries (key, s, e), points (key, s, e, crc) -> (key, s, e, relation, n, slots, crc) per distinct query and relation that has points.

    Both are intervals of slots, e = FAR where open. slots is null where both are open. Rows with a null are left out.
    """
    queries = queries.select("key", "s", "e").dropna().distinct()
    points = written(points.select("key", "s", "e", "crc").dropna().groupBy("key", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "points")
    queries = written(queries, "asked")
    ends = F.when(F.col("e") < FAR, F.col("e") * F.col("n")).otherwise(0)
    sums = points.select("*", (F.col("s") * F.col("n")).alias("ss"), ends.alias("se"))

    def row(df, kind, block, **own):
        named = {"key": F.col("key"), "block": block, "kind": kind if isinstance(kind, Column) else F.lit(kind)} | own
        return df.select(*[named.get(f, F.lit(0)).cast(t).alias(f) for f, t in (x.split() for x in ROW.split(", "))])

    sums_of = {c: F.col(c) for c in SUMS}
    begins, ended = (row(sums, kind, _block(c), s=F.col("s"), e=F.col("e"), **sums_of) for kind, c in ((BEGINS, "s"), (ENDS, "e")))
    spans = sums.where((F.col("e") < FAR) & (_block("e") > _block("s"))).select("*", F.explode(F.sequence(_block("s") + 1, _block("e"))).alias("block"))
    carried = row(spans.groupBy("key", "block", "e").agg(*[F.sum(c).alias(c) for c in SUMS]), CARRIED, F.col("block"), e=F.col("e"), **sums_of)
    asks = [row(queries, kind, _block(c), s=F.col("s"), e=F.col("e")) for kind, c in ((FROM, "s"), (TO, "e"))]

    # the sums of earlier blocks: one row per key and block
    totals = {kind: [F.sum(F.when(of, F.col(c))).alias(f"{c}{kind}") for c in SUMS] for kind, of in ((BEGUN, F.col("kind") == BEGINS), (ENDED, F.col("kind") == ENDS), (OPENED, (F.col("kind") == BEGINS) & (F.col("e") == FAR)))}
    blocks = begins.unionByName(ended).unionByName(asks[0]).unionByName(asks[1]).groupBy("key", "block").agg(*[x for xs in totals.values() for x in xs])
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("key", "block", *[F.coalesce(F.sum(f"{c}{kind}").over(earlier), F.lit(0)).alias(f"{c}{kind}") for kind in totals for c in SUMS])
    base = base.select("key", "block", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), *[F.col(f"{c}{kind}").alias(c) for c in SUMS]) for kind in totals])))
    base = row(base.where("n > 0"), F.col("kind"), F.col("block"), **sums_of)

    rows = base
    for df in (carried, begins, ended, *asks):
        rows = rows.unionByName(df)
    found = rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_count, FOUND)
    found = found.groupBy("key", "s", "e", "relation").agg(F.sum("n").alias("n"), F.sum("slots").alias("slots"), F.sum("crc").alias("crc")).where("n > 0")
    both_open = (F.col("e") == FAR) & F.col("relation").isin(FINISHED_BY, EQUALS, FINISHES)
    return found.withColumn("slots", F.when(~both_open, F.col("slots"))).withColumn("relation", F.array(*map(F.lit, RELATIONS))[F.col("relation")])


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    t = F.col(column)
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(t)
    return F.unix_date(t.cast("date")).cast("long") * DAY + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def sessions(clicks: DataFrame, pause: int = PAUSE) -> DataFrame:
    """clicks (client_id, ts, kind) -> (client_id, first, last, open), times in microseconds."""
    rows = clicks.select("client_id", micros(clicks, "ts").alias("t"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("bad")).where("client_id IS NOT NULL AND t IS NOT NULL")
    part = floor_div(F.col("t"), pause)
    rows = rows.groupBy("client_id", part.alias("part")).agg(F.min("t").alias("first"), F.max(F.col("t") * 2 + F.col("bad").cast("long")).alias("till"))  # one number, so that rows are aggregated by hash
    day = floor_div(F.col("part") * F.lit(pause).cast("long"), DAY)
    in_day = Window.partitionBy("client_id", "day").orderBy("first")

    def runs(df, window, keys):
        new = F.coalesce(F.col("first") - F.shiftright(F.lag("till").over(window), 1) > pause, F.lit(True)).cast("int")
        df = df.withColumn("new", new).withColumn("run", F.sum("new").over(window))
        return df.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("till").alias("till"))

    daily = runs(rows.withColumn("day", day), in_day, ["client_id", "day"])
    edge = (F.col("run") == 1) | (F.col("run") == F.max("run").over(Window.partitionBy("client_id", "day")))
    daily = written(daily.withColumn("edge", edge), "runs")
    over_days = runs(daily.where("edge").select("client_id", "first", "till"), Window.partitionBy("client_id").orderBy("first"), ["client_id"])
    found = daily.where("NOT edge").select("client_id", "first", "till").unionByName(over_days.select("client_id", "first", "till"))
    return found.select("client_id", "first", F.shiftright("till", 1).alias("last"), (F.pmod("till", F.lit(2)) == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame, slot: int = SLOT) -> DataFrame:
    """(sale_id, key, s, e) of sales that have a client and a time."""
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("t")).dropna().groupBy("sale_id").agg(F.max("t").alias("shipped"))
    rows = sales.select("sale_id", F.col("client_id").alias("key"), micros(sales, "sold_at").alias("sold"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).where("key IS NOT NULL AND sold IS NOT NULL")
    # a hint, so that no side is broadcast, which would grow with the input
    rows = rows.join(shipped.hint("merge"), "sale_id", "left")
    end = F.when(F.col("open"), FAR).otherwise(floor_div(F.greatest("sold", "shipped"), slot))
    return rows.select("sale_id", "key", floor_div(F.col("sold"), slot).alias("s"), end.alias("e"))


def overlap_join(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc)"""
    points = sessions(clicks).select(F.col("client_id").alias("key"), floor_div(F.col("first"), SLOT).alias("s"), F.when(F.col("open"), FAR).otherwise(floor_div(F.col("last"), SLOT)).alias("e"), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc"))
    asked = written(sale_intervals(sales, lines), "sales")
    found = relations(asked, points)
    return asked.join(found.hint("merge"), ["key", "s", "e"]).select("sale_id", "relation", F.col("n").alias("n_pairs"), F.col("slots").alias("overlap_slots"), F.col("crc").alias("sessions_crc"))


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join(table(spark, sf_dir, "sales", "sale_id", "client_id", "status", "sold_at"), table(spark, sf_dir, "sale_lines", "sale_id", "shipped_at"), table(spark, sf_dir, "clicks", "client_id", "ts", "kind"))


#: DuckDB has no crc32 of text: a table of its 256 steps is folded over the digits.
ORACLE = """
WITH RECURSIVE
bits AS (SELECT i, i AS v, 0 AS step FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
steps AS (SELECT list(v ORDER BY i) AS table_of FROM bits WHERE step = 8),
seen AS (SELECT client_id, epoch_us(ts) AS t, coalesce(kind = 'error', false) AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
broken AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY client_id ORDER BY t) > 1800000000, true) AS new FROM seen),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY client_id ORDER BY t) AS run FROM broken),
ends AS (SELECT client_id, run, min(t) AS first, max(t) AS last FROM numbered GROUP BY 1, 2),
sessions AS (SELECT e.client_id, e.first, e.last, bool_or(n.bad) AS open FROM ends e JOIN numbered n ON n.client_id = e.client_id AND n.run = e.run AND n.t = e.last GROUP BY 1, 2, 3),
hashed AS (SELECT client_id, first // 21600000000 AS s, CASE WHEN open THEN 1000000000 ELSE last // 21600000000 END AS e,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(first::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: xor(x >> 8, table_of[(xor(x, y) & 255) + 1])), 4294967295) AS crc FROM sessions CROSS JOIN steps),
shipped AS (SELECT sale_id, max(epoch_us(shipped_at)) AS t FROM sale_lines GROUP BY 1),
intervals AS (SELECT a.sale_id, a.client_id, epoch_us(a.sold_at) // 21600000000 AS s, CASE WHEN a.status = 'open' THEN 1000000000 ELSE greatest(epoch_us(a.sold_at), coalesce(b.t, epoch_us(a.sold_at))) // 21600000000 END AS e
    FROM sales a LEFT JOIN shipped b USING (sale_id) WHERE a.client_id IS NOT NULL AND a.sold_at IS NOT NULL),
pairs AS (SELECT a.sale_id, sign(a.s - b.s) AS at_start, sign(a.e - b.e) AS at_end, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS slots, a.e = 1000000000 AND b.e = 1000000000 AS endless, b.crc
    FROM intervals a JOIN hashed b ON a.client_id = b.client_id AND b.s <= a.e AND a.s <= b.e)
SELECT sale_id, CASE at_start WHEN -1 THEN CASE at_end WHEN -1 THEN 'overlaps' WHEN 0 THEN 'finished_by' ELSE 'contains' END
        WHEN 0 THEN CASE at_end WHEN -1 THEN 'starts' WHEN 0 THEN 'equals' ELSE 'started_by' END
        ELSE CASE at_end WHEN -1 THEN 'during' WHEN 0 THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
    count(*) AS n_pairs, sum(CASE WHEN NOT endless THEN slots END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM pairs GROUP BY 1, 2
"""
