"""A log-structured search index: immutable segments, one per run, and states that say which of them live.

    <root>/seg=<name>/<table>/      what a run added, and what it takes away
    <root>/log/<number>             a state (JSON): settings, live segments with their levels and digest roots; the greatest number counts
    <root>/norms=<segments>/        what follows from all live segments at once, made by the first searcher that needs it

A run that changes a few files writes a segment of their size. It holds their sections, children and postings; for each file that it
replaces or deletes a row of `dead` (the segment that has it, the file) and of `dead_ids` (its sections); and changes of document frequencies and of
totals, with a minus sign for what goes, so that sums over live segments are those of the live corpus. Nothing else is read or written but the
dead files' own sections.

Postings are blocks: a token's postings in one group of GROUP sections (or children) that are stored one after another, with the greatest count, the
least length and whether any is in a heading. A posting is its section's place in the group and its count; ids and lengths are in `groups`, a row per
group. No token, however frequent, is gathered in one place. Blocks lie sorted by token in files whose ranges of
tokens don't overlap, but where one token fills several; `ranges` has the first and last token of each, files have Bloom filters of their
tokens and pages of PAGE_ROWS blocks, so a reader of some tokens reads the pages that have them.

Sections and children are stored as they come, so neither texts nor tokens are shuffled. A worker counts a few groups at a time and makes their blocks, which are
shuffled once, to their files; these have about equally many postings by the tokens of some sections.

Tiered compaction: FAN segments of a level become one of the next, from their live sections alone, so each section is rewritten once per level.
Every segment has a digest per file under one root (digests), which readers hold the files against that they read.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import packed
from quillspark.functions.text import tokenize
from quillspark.operators import chunking, ranking
from quillspark.sources import digests, index_store

#: Sections or children of a group; segments of a level that are merged into one.
GROUP, FAN = 128, 4
#: Blocks of a page and about of a file; tokens up to which a scan is told them all.
PAGE_ROWS, FILE_ROWS, PUSHED = 1024, 200_000, 256
#: Bytes of tokens that a worker makes blocks of at a time, and of a row group of sections; tokens for each part of the range, to choose it by.
SLICE, ROW_GROUP, PART_TOKENS = 8 << 20, 8 << 20, 200
VERSION = 2
FILES = "path string, size long, mtime_ns long, content_hash string"
SECTIONS = "id string, file string, heading string, heading_path array<string>, content string, tokens array<string>"
TABLES = {
    "files": FILES,
    "sections": f"{SECTIONS}, dl int, grp long, place int",
    "groups": "grp long, ids array<string>, dls array<int>",
    "lexical": "token string, grp long, n int, max_tf int, min_dl int, heading boolean, places array<tinyint>, tfs array<int>, headings array<boolean>",
    "vectors": "id string, source_id string, grp long, place int, most long, terms array<struct<token:string,tf:long>>",
    "child_groups": "grp long, ids array<string>, source_ids array<string>, mosts array<int>",
    "child_blocks": "token string, grp long, n int, places array<tinyint>, tfs array<int>",
    "terms": "token string, df long, max_tf long, min_dl int, heading boolean",
    "child_terms": "token string, df long",
    "stats": "n_sections long, total_len long, n_files long, n_children long",
    "dead": "segment string, file string",
    "dead_ids": "segment string, id string",
    "ranges": "name string, file string, first string, last string",
}


class Conflict(Exception):
    """Another writer has made a state meanwhile; nothing has changed."""


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _empty(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows, for which no Python worker is started."""
    return spark.range(0, 0, 1, 1).selectExpr(*["CAST(NULL AS {1}) AS {0}".format(*c.split(" ", 1)) for c in TABLES[name].split(", ")])


def state(spark: SparkSession, root: str) -> dict | None:
    numbers = index_store._pointers(spark, root, "log")
    return json.loads(index_store._read_text(spark, f"{root}/log/{numbers[-1]}")) | {"number": int(numbers[-1])} if numbers else None


def _commit(spark: SparkSession, root: str, old: dict | None, segments: list[dict], settings: dict) -> dict:
    new = {"version": VERSION, "settings": settings, "segments": segments, "number": (old["number"] if old else 0) + 1}
    if not index_store._write_text(spark, f"{root}/log/{new['number']:020d}", json.dumps(new, sort_keys=True)):
        raise Conflict(f"state {new['number']} was made by another writer")
    return new


# writing


def _placed(rows: DataFrame) -> DataFrame:
    """With the number of a group of GROUP neighbours and the place in it, as the rows come."""
    at = F.monotonically_increasing_id()
    return rows.withColumn("at", at).select(*rows.columns, F.shiftright("at", GROUP.bit_length() - 1).alias("grp"), (F.col("at") % GROUP).cast("int").alias("place"))


def _groups(rows: DataFrame, **lists) -> DataFrame:
    """A row per group; its lists are in order of place."""
    got = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("place", *[c.alias(name) for name, c in lists.items()]))).alias("all"))
    return got.select("grp", *[F.col(f"all.{name}").alias(name) for name in lists])


def cuts(tokens: DataFrame, parts: int) -> list[str]:
    """parts - 1 tokens, in order, that part tokens (token) into about equal shares. A token of several shares is there several times."""
    found = sorted(r["token"] for r in tokens.collect()) if parts > 1 else []
    return [found[len(found) * k // parts] for k in range(1, parts)] if found else []


def _blocked(rows: DataFrame, bounds: list[str], lexical: bool) -> DataFrame:
    """Blocks of rows (grp, place, text; of lexical ones also dl and head, else tfs) that lie by group, as partitions of the token range, sorted by token and group.

    text and head are tokens joined by spaces, which go to Python faster than arrays; tfs their counts, if a token is there once. A worker takes whole groups, of SLICE bytes if one has no more, and packs
    the blocks that go to one partition as a compressed Arrow table: what is shuffled takes about what the blocks take when they are stored.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pack, unpack = packed.codec()

    def whole_groups(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([*([kept] if kept else []), b]).combine_chunks()
            grp = t.column("grp").to_numpy()
            if not len(grp):
                continue
            fresh = np.append(0, np.flatnonzero(grp[1:] != grp[:-1]) + 1)
            sizes = np.add.reduceat(pc.binary_length(t.column("text")).to_numpy().astype(np.int64), fresh)
            a, n = 0, 0
            for at, size in zip(fresh, sizes):
                if n and n + size > SLICE:
                    yield t.slice(a, at - a).combine_chunks()
                    a, n = at, 0
                n += size
            if fresh[-1] > a:
                yield t.slice(a, fresh[-1] - a).combine_chunks()
            kept = t.slice(fresh[-1]).combine_chunks().to_batches()[0]
        if kept:
            yield pa.Table.from_batches([kept])

    def split(texts):
        """The rows and tokens of texts; an empty one has none."""
        lists = pc.split_pattern(texts.combine_chunks(), " ")
        n, some = np.diff(lists.offsets.to_numpy()), pc.binary_length(texts).to_numpy() > 0
        flat = lists.flatten()
        return np.repeat(np.arange(len(lists))[some], n[some]), flat if some.all() else flat.filter(pc.not_equal(flat, ""))

    def run(batches):
        starts = np.array(bounds, object)
        for t in whole_groups(batches):
            grp, place = t.column("grp").to_numpy(), t.column("place").to_numpy()
            row, flat = split(t.column("text"))
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            words, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key = row * len(words) + rank[coded.indices.to_numpy()]
            if lexical:
                key, tf = np.unique(key, return_counts=True)
            else:
                first = np.argsort(key, kind="stable")
                key, tf = key[first], t.column("tfs").combine_chunks().flatten().to_numpy()[first]
            by_token = np.argsort(key % len(words), kind="stable")
            key, tf = key[by_token], tf[by_token].astype(np.int32)
            row, word = key // len(words), key % len(words)
            g = grp[row]
            begins = np.append(0, np.flatnonzero((word[1:] != word[:-1]) | (g[1:] != g[:-1])) + 1)
            offsets, word, g = pa.array(np.append(begins, len(row)), pa.int32()), word[begins], g[begins]
            lists_of = lambda x: pa.ListArray.from_arrays(offsets, x)
            out = {"token": words.take(pa.array(word)), "grp": pa.array(g), "places": lists_of(pa.array(place[row], pa.int8())), "tfs": lists_of(pa.array(tf))}
            if lexical:
                owner, heads = split(t.column("head"))
                known = pc.index_in(heads, value_set=words)
                owner = owner[known.is_valid().to_numpy(zero_copy_only=False)]
                inside = np.isin(key, owner * len(words) + known.drop_null().to_numpy())
                none = ~np.logical_or.reduceat(inside, begins)
                out["min_dl"] = pa.array(np.minimum.reduceat(t.column("dl").to_numpy()[row], begins), pa.int32())
                out["headings"] = pa.ListArray.from_arrays(offsets, pa.array(inside), mask=pa.array(none))
            # a token of several parts is dealt to them by group
            text = np.array(words.to_pylist(), object)
            low, high = (np.searchsorted(starts, text, side)[word] for side in ("left", "right")) if len(starts) else (np.zeros(len(word), np.int64),) * 2
            part = low + (g + (g >> 20)) % (high - low + 1)
            order = np.argsort(part, kind="stable")
            table = pa.table(out).take(pa.array(order)).combine_chunks()
            edges = np.append(np.append(0, np.flatnonzero(np.diff(part[order])) + 1), len(part))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part[order][edges[:-1]], pa.int32()), "packed": pa.array([pack(table.slice(a, z - a)) for a, z in zip(edges, edges[1:])], pa.binary())})

    def gather(batches):
        parts = [unpack(x) for b in batches for x in b.column("packed")]
        if parts:
            yield from pa.concat_tables(parts).sort_by([("token", "ascending"), ("grp", "ascending")]).combine_chunks().to_batches(8192)

    packs = rows.mapInArrow(run, "part int, packed binary").repartitionById(len(bounds) + 1, "part").select("packed")
    return packs.mapInArrow(gather, "token string, grp long, places array<tinyint>, tfs array<int>" + (", min_dl int, headings array<boolean>" if lexical else ""))


def lexical_blocks(sections: DataFrame, bounds: list[str] = []) -> DataFrame:
    rows = sections.select("grp", "place", "dl", F.array_join(tokenize(F.concat_ws(" ", "heading_path")), " ").alias("head"), F.array_join("tokens", " ").alias("text"))
    return _blocked(rows, bounds, True)


def child_vectors(children: DataFrame) -> DataFrame:
    """One row per child, also for those without tokens, since they count."""
    return _placed(ranking.child_bags(ranking.child_tokens(children))).select("id", "source_id", "grp", "place", "most", "terms")


def child_blocks(vectors: DataFrame, bounds: list[str] = []) -> DataFrame:
    return _blocked(vectors.select("grp", "place", F.array_join("terms.token", " ").alias("text"), F.col("terms.tf").alias("tfs")), bounds, False)


def _ends(rows: DataFrame) -> DataFrame:
    """(file, first, last) of runs of rows (file, token) of sorted files: a run's least and greatest token are its ends, so nothing is sorted for them."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                code = b.column("file").dictionary_encode().indices.to_numpy()
                at = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
                yield pa.RecordBatch.from_arrays([b.column("file").take(pa.array(at)), b.column("token").take(pa.array(at)), b.column("token").take(pa.array(np.append(at[1:], len(code)) - 1))], names=["file", "first", "last"])

    return rows.mapInArrow(run, "file string, first string, last string")


class _Writer:
    """Writes the tables of one segment and reads them back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.name = spark, uuid.uuid4().hex
        self.base, self.ranges = f"{root}/seg={self.name}", []
        self.root, self.taken = root, f"making-{self.name}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        out = df.write.option("compression", index_store.CODEC)
        if name in ("sections", "vectors"):  # tasks that make blocks read row groups
            out = out.option("parquet.block.size", str(ROW_GROUP))
        out.parquet(f"{self.base}/{name}")
        return self.read(name)

    def blocks(self, name: str, make, rows: DataFrame, tokens, n: int) -> DataFrame:
        """make(rows, bounds), sorted by token, in files whose ranges are noted. rows have about n blocks; tokens: the distinct ones of a row, of which some choose the bounds."""
        parts = max(1, -(-n // FILE_ROWS))
        some = rows.select("grp", tokens.alias("token"))
        if (share := PART_TOKENS * parts / max(n, 1)) < 1:
            some = some.sample(share, 0)
        df = make(rows, cuts(some.select(F.explode("token").alias("token")), parts) if parts > 1 else [])
        df = df.select(*[{"n": F.size("places"), "max_tf": F.array_max("tfs"), "heading": F.col("headings").isNotNull() if "headings" in df.columns else None}.get(c, F.col(c)).alias(c) for c in (x.split()[0] for x in TABLES[name].split(", "))])
        out = df.write.option("compression", index_store.CODEC).option("parquet.page.row.count.limit", str(PAGE_ROWS))
        if n > PAGE_ROWS:  # the ranges say enough of small files
            out = out.option("parquet.bloom.filter.enabled#token", "true").option("parquet.bloom.filter.expected.ndv#token", str(min(n, FILE_ROWS)))
        out.parquet(f"{self.base}/{name}")
        read = self.read(name)
        self.ranges.append(_ends(read.select(F.col("_metadata.file_name").alias("file"), "token")).groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(F.lit(name).alias("name"), "file", "first", "last"))
        return read

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.base}/{name}")

    def drop_taken(self) -> None:
        _, fs, p = index_store._fs(self.spark, f"{self.root}/{self.taken}")
        fs.delete(p, True)

    def done(self, level: int) -> dict:
        self("ranges", _union(self.ranges).coalesce(1))
        return {"name": self.name, "level": level, "root": digests.record(self.spark, self.base)}


def _searchable(write: _Writer, sections: DataFrame, policy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of both rankers over a segment's sections -> (stored sections, lexical blocks, child blocks)."""
    columns = [c.split()[0] for c in SECTIONS.split(", ")]
    own = write("sections", _placed(sections.select(*columns, F.greatest(F.size("tokens"), F.lit(1)).alias("dl"))))
    n = own.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]  # tokens: blocks are fewer
    write("groups", _groups(own, ids=F.col("id"), dls=F.col("dl")))
    lexical = write.blocks("lexical", lexical_blocks, own, F.array_distinct("tokens"), n // 6)
    vectors = write("vectors", child_vectors(chunking.children(own, policy)))
    write("child_groups", _groups(vectors, ids=F.col("id"), source_ids=F.col("source_id"), mosts=F.coalesce("most", F.lit(0)).cast("int")))
    return own, lexical, write.blocks("child_blocks", child_blocks, vectors, F.col("terms.token"), n // 6)


def _totals(sections: DataFrame, files: DataFrame, n_children: DataFrame, sign: int) -> DataFrame:
    """One row of stats. n_children: one row (n)."""
    s = sections.agg(F.count("*").alias("n_sections"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_len"))
    return s.crossJoin(files.agg(F.count("*").alias("n_files"))).crossJoin(n_children.select(F.col("n").alias("n_children"))).select(*[(F.lit(sign) * F.col(c)).cast("long").alias(c) for c in ("n_sections", "total_len", "n_files", "n_children")])


def update(spark: SparkSession, root: str, sections: DataFrame, files: DataFrame | None = None, gone: DataFrame | None = None, settings: dict | None = None, policy: chunking.ChunkingPolicy = chunking.ChunkingPolicy(), activate=lambda: True) -> dict:
    """Add a segment of sections and the files they are from, in place of what the index has of these files and of those that are gone (path).

    files: (path, size, mtime_ns, content_hash), by default just the sections' files. activate() is asked last; the new state is returned.
    """
    old = state(spark, root)
    if old and (old["version"] != VERSION or old["settings"] != (settings or {})):
        raise ValueError("the index has other settings")
    write = _Writer(spark, root)
    if files is None:
        files = sections.select(F.col("file").alias("path")).distinct().selectExpr("path", "CAST(NULL AS long) AS size", "CAST(NULL AS long) AS mtime_ns", "CAST(NULL AS string) AS content_hash")
    files = write("files", files.select([c.split()[0] for c in FILES.split(", ")]))
    own, lexical, kids = _searchable(write, sections, policy)
    terms = lexical.groupBy("token").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.bool_or("heading").alias("heading"))
    child_terms = kids.groupBy("token").agg(F.sum("n").alias("df"))
    stats = _totals(own, files, write.read("vectors").agg(F.count("*").alias("n")), 1)
    if old:
        before = Segments(spark, root, old)
        paths = files.select(F.col("path").alias("file"))
        paths = paths if gone is None else paths.union(gone.select(F.col("path").alias("file"))).distinct()
        dead_files = before.live("files", "path").select("segment", F.col("path").alias("file")).join(paths, "file", "left_semi").select("segment", "file")
        dead = write("dead", dead_files)
        before.live("sections").join(ranking.small(dead), ["segment", "file"], "left_semi").write.parquet(f"{root}/{write.taken}", compression=index_store.CODEC)
        lost = spark.read.schema(f"segment string, {SECTIONS}").parquet(f"{root}/{write.taken}")  # all sections are read for them, once
        write("dead_ids", lost.select("segment", "id"))
        minus = -F.count("*")
        terms = terms.unionByName(lost.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(minus.alias("df")), allowMissingColumns=True)
        lost_kids = ranking.child_tokens(chunking.children(lost.drop("segment"), policy))
        child_terms = child_terms.unionByName(lost_kids.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(minus.alias("df")))
        stats = stats.unionByName(_totals(lost, dead, lost_kids.agg(F.count("*").alias("n")), -1))
    else:
        for name in ("dead", "dead_ids"):
            write(name, _empty(spark, name))
    write("terms", _summed_terms(terms))
    write("child_terms", child_terms.groupBy("token").agg(F.sum("df").alias("df")))
    write("stats", stats)
    write.drop_taken()
    if not activate():
        raise RuntimeError("activation was refused: the corpus has changed meanwhile")
    new = _commit(spark, root, old, [*(old["segments"] if old else []), write.done(0)], settings or {})
    return compact(spark, root, policy) if old else new


def _summed_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("token").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), F.bool_or("heading").alias("heading"))


def compact(spark: SparkSession, root: str, policy: chunking.ChunkingPolicy = chunking.ChunkingPolicy()) -> dict:
    """Merge levels of FAN segments or more, lowest first, until there are none. Live rows are rewritten; sums of changes stay what they are."""
    now = state(spark, root)
    while True:
        levels: dict[int, list[dict]] = {}
        for s in now["segments"]:
            levels.setdefault(s["level"], []).append(s)
        full = min((k for k, v in levels.items() if len(v) >= FAN), default=None)
        if full is None:
            return now
        old, names = Segments(spark, root, now), [s["name"] for s in levels[full]]
        write = _Writer(spark, root)
        write("files", old.live("files", "path", names).drop("segment"))
        _searchable(write, old.live("sections", "file", names).drop("segment"), policy)
        part = lambda name: old.raw(name, names).drop("segment" if name not in ("dead", "dead_ids") else "_of")
        write("terms", _summed_terms(part("terms")))
        write("child_terms", part("child_terms").groupBy("token").agg(F.sum("df").alias("df")))
        write("stats", part("stats").agg(*[F.sum(c).alias(c) for c in ("n_sections", "total_len", "n_files", "n_children")]))
        for name in ("dead", "dead_ids"):  # those of merged segments are gone by now
            write(name, part(name).where(~F.col("segment").isin(names)))
        merged = write.done(full + 1)
        now = _commit(spark, root, now, [s for s in now["segments"] if s["name"] not in names] + [merged], now["settings"])


@contextmanager
def told(spark: SparkSession):
    """While plans run within, scans are told up to PUSHED tokens one by one, for their pages; by default a list of more than ten is a range to them."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PUSHED))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def vacuum(spark: SparkSession, root: str, states: int = 2) -> list[str]:
    """Remove what no state of the latest ones names: segments merged or never committed, norms, unfinished tables. Readers of older states must be done."""
    keep: set[str] = set()
    for number in index_store._pointers(spark, root, "log")[-states:]:
        names = [s["name"] for s in json.loads(index_store._read_text(spark, f"{root}/log/{number}"))["segments"]]
        keep |= {f"seg={n}" for n in names} | {f"norms={_norms_key(names)}"}
    _, fs, p = index_store._fs(spark, root)
    found = [x.getPath() for x in fs.listStatus(p)]
    gone = [x for x in found if x.getName().startswith(("seg=", "norms=", "making-")) and x.getName() not in keep]
    for x in gone:
        fs.delete(x, True)
    return sorted(x.getName() for x in gone)


def _norms_key(names: list[str]) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, "/".join(sorted(names))).hex


# reading


class Segments:
    """The live index at a state. Tables are views over its segments; lookups by token read the files and pages that can have them."""

    def __init__(self, spark: SparkSession, root: str, at: dict | None = None, checked: bool = True):
        self.spark, self.root, self.checked = spark, root, checked
        self.state = at or state(spark, root)
        if self.state is None:
            raise FileNotFoundError(f"{root} has no index")
        if self.state["version"] != VERSION:
            raise ValueError(f"the index has version {self.state['version']}, not {VERSION}")
        self.names = [s["name"] for s in self.state["segments"]]
        self._made: dict = {}

    def _files(self, segment: str, name: str, files: list[str] | None = None) -> list[str]:
        base, there = f"{self.root}/seg={segment}", f"seg={segment}"
        own = [f"{name}/{f}" for f in files] if files is not None else [f for f, _, _ in digests.listed(self.spark, base) if f.startswith(f"{name}/")]
        if self.checked and own:
            digests.check(self.spark, base, next(s["root"] for s in self.state["segments"] if s["name"] == segment), own)
        return [f"{self.root}/{there}/{f}" for f in own]

    def raw(self, name: str, names: list[str] | None = None, files: dict[str, list[str]] | None = None) -> DataFrame:
        """A table of some segments (all by default), with the segment (`_of` for tables that have a column of that name)."""
        parts, column = [], "_of" if name in ("dead", "dead_ids") else "segment"
        for segment in self.names if names is None else names:
            own = self._files(segment, name, None if files is None else files.get(segment, []))
            df = self.spark.read.schema(TABLES[name]).parquet(*own) if own else _empty(self.spark, name)
            parts.append(df.withColumn(column, F.lit(segment)))
        return _union(parts)

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def dead(self, name: str) -> DataFrame | None:
        """`dead` or `dead_ids` of all live segments; None if there are none."""
        def make():
            rows = self.raw(name).drop("_of")
            return None if rows.isEmpty() else ranking.small(rows)

        return self._once(name, make)

    def live(self, name: str, file: str = "file", names: list[str] | None = None) -> DataFrame:
        """files or sections without those of replaced and deleted files."""
        rows, dead = self.raw(name, names).drop("dl", "grp", "place"), self.dead("dead")
        return rows if dead is None else rows.join(dead.withColumnRenamed("file", file), ["segment", file], "left_anti")

    def without_dead(self, rows: DataFrame, id: str) -> DataFrame:
        dead = self.dead("dead_ids")
        return rows if dead is None else rows.join(dead.withColumnRenamed("id", id), ["segment", id], "left_anti")

    # sums over segments

    def stats(self) -> DataFrame:
        s = self.raw("stats").agg(*[F.sum(c).alias(c) for c in ("n_sections", "total_len", "n_files", "n_children")])
        return s.select("n_sections", F.coalesce(F.col("total_len") / F.nullif(F.col("n_sections"), F.lit(0)), F.lit(0.0)).alias("avg_len"), "n_files", "n_children")

    def terms(self) -> DataFrame:
        """(token, df, idf, avg_len, max_tf, min_dl, heading)"""
        sums = _summed_terms(self.raw("terms")).where("df > 0")
        n = F.col("n_sections")
        return sums.crossJoin(F.broadcast(self.stats())).select("token", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len", "max_tf", "min_dl", "heading")

    def child_terms(self) -> DataFrame:
        sums = self.raw("child_terms").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        return sums.crossJoin(F.broadcast(self.stats())).select("token", "df", (F.log((F.col("n_children") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    # whole tables, for those who need all rows

    def children(self, policy: chunking.ChunkingPolicy = chunking.ChunkingPolicy()) -> DataFrame:
        return chunking.children(self.live("sections").drop("segment"), policy)

    def _living(self, name: str, id: str) -> DataFrame:
        """groups or child_groups, in which those of replaced and deleted files have no id."""
        rows, dead = self.raw(name), self.dead("dead_ids")
        if dead is None:
            return rows
        owner = {"id": "ids", "source_id": "source_ids"}[id]
        gone = rows.select("segment", "grp", F.explode(owner).alias("id")).join(dead, ["segment", "id"]).groupBy("segment", "grp").agg(F.collect_set("id").alias("gone"))
        alive = F.when(F.col("gone").isNull(), F.col("ids")).otherwise(F.transform("ids", lambda x, i: F.when(~F.array_contains("gone", F.get(F.col(owner), i)), x)))
        return rows.join(gone, ["segment", "grp"], "left").withColumn("ids", alive).drop("gone")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """All, or those of tokens (token), for which only files and pages that can have them are read. Those of a section lie together, one after another."""
        rows = self.raw("lexical") if tokens is None else self.blocks("lexical", tokens)
        # a group's blocks meet its ids as one row
        rows = rows.groupBy("segment", "grp").agg(F.collect_list(F.struct("token", "places", "tfs", "headings")).alias("blocks"))
        rows = rows.join(self._living("groups", "id"), ["segment", "grp"])
        entry = lambda b: F.transform(F.arrays_zip(b["places"].alias("places"), b["tfs"].alias("tfs")), lambda x, i: F.struct(x["places"].cast("int").alias("place"), x["tfs"].cast("long").alias("tf"), F.coalesce(F.get(b["headings"], i), F.lit(False)).alias("in_heading"), b["token"].alias("token")))
        rows = rows.select("ids", "dls", F.inline_outer(F.sort_array(F.flatten(F.transform("blocks", entry)))))
        rows = rows.select(F.get("ids", "place").alias("id"), "token", "tf", F.get("dls", "place").alias("dl"), "in_heading")
        return rows.where("id IS NOT NULL").select("*", ranking.bucket().alias("bucket"))

    def bags(self) -> DataFrame:
        """(id, source_id, most, terms) of all live children: what a batch of many tokens reads, as its postings would be most of them."""
        return self.without_dead(self.raw("vectors"), "source_id").select("id", "source_id", "most", "terms")

    def child_counts(self) -> DataFrame:
        rows = self.raw("vectors").select("segment", "id", "source_id", "most", F.inline("terms"))
        return self.without_dead(rows, "source_id").select("id", "source_id", "token", "tf", "most")

    def norms(self) -> DataFrame:
        """(id, norm) of all live children: it follows from all frequencies, so each state has its own, stored by the first that asks."""

        def make():
            path = f"{self.root}/norms={_norms_key(self.names)}"
            jvm, fs, p = index_store._fs(self.spark, f"{path}/_SUCCESS")
            if not fs.exists(p):
                rows = ranking.child_norms(self.child_counts(), self.child_terms())
                part = f"{self.root}/making-{uuid.uuid4().hex}"
                rows.write.parquet(part)
                made = jvm.org.apache.hadoop.fs.Path(part)
                if not fs.rename(made, jvm.org.apache.hadoop.fs.Path(path)):
                    fs.delete(made, True)  # another searcher was first
            return self.spark.read.schema("id string, norm double").parquet(path)

        return self._once("norms", make)

    def _asked_counts(self, tokens: DataFrame) -> DataFrame:
        """child_counts() of tokens (token), from the files and pages that can have them."""
        rows = self.blocks("child_blocks", tokens).groupBy("segment", "grp").agg(F.collect_list(F.struct("token", "places", "tfs")).alias("blocks"))
        rows = rows.join(self._living("child_groups", "source_id"), ["segment", "grp"])
        entry = lambda b: F.transform(F.arrays_zip(b["places"].alias("places"), b["tfs"].alias("tfs")), lambda x: F.struct(x["places"].cast("int").alias("place"), b["token"].alias("token"), x["tfs"].cast("long").alias("tf")))
        rows = rows.select("ids", "source_ids", "mosts", F.inline_outer(F.flatten(F.transform("blocks", entry))))
        return rows.select(F.get("ids", "place").alias("id"), F.get("source_ids", "place").alias("source_id"), "token", "tf", F.get("mosts", "place").cast("long").alias("most")).where("id IS NOT NULL")

    def child_postings(self, tokens: DataFrame | None = None) -> DataFrame:
        counts, terms = self.child_counts() if tokens is None else self._asked_counts(tokens), self.child_terms()
        if tokens is not None:  # only their counts are joined with norms
            terms = terms.join(ranking.small(tokens.select("token").distinct()), "token", "left_semi")
        rows = ranking.weighed(counts, terms).join(self.norms(), "id")
        return rows.select("id", "source_id", "token", "tf", (F.col("tf") / F.col("most") * F.col("idf")).alias("weight"), "norm", ranking.bucket().alias("bucket"))

    def tables(self) -> dict[str, DataFrame]:
        """What plans.search.Search reads."""
        sections = self.live("sections").drop("segment")
        return {"sections": sections, "children": self.children(), "stats": self.stats().select("n_sections", "avg_len", "n_files"), "postings": self.postings(), "terms": self.terms().select("token", "df", "idf", "avg_len"), "child_counts": self.child_counts(), "child_terms": self.child_terms(), "child_postings": self.child_postings()}

    def search_tables(self, queries: DataFrame) -> dict[str, DataFrame]:
        """The same for these queries alone: postings of their tokens."""
        tokens = ranking.query_tokens(queries).select("token").distinct()
        return self.tables() | {"postings": self.postings(tokens), "child_postings": self.child_postings(tokens)}

    # by token

    def blocks(self, name: str, tokens: DataFrame) -> DataFrame:
        """lexical or child_blocks of some tokens (token): files by their ranges, and up to PUSHED tokens their pages."""
        ranges = self._once("ranges", lambda: self.raw("ranges"))
        wanted = ranking.small(tokens.select("token").distinct())
        own = ranges.where(F.col("name") == name).join(wanted, F.col("token").between(F.col("first"), F.col("last")), "left_semi").select("segment", "file").collect()  # files that some token may be in
        files: dict[str, list[str]] = {}
        for r in own:
            files.setdefault(r["segment"], []).append(r["file"])
        rows = self.raw(name, [s for s in self.names if s in files] or self.names[:1], files)
        few = [r["token"] for r in tokens.select("token").distinct().limit(PUSHED + 1).collect()]
        return rows.where(F.col("token").isin(few)) if len(few) <= PUSHED else rows.join(wanted, "token", "left_semi")
