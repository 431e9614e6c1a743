"""Parent sections to bounded, overlapping children."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import content_hash, embedded_text, heading_context, normalize


#: The greatest child, number of separators, and length of one.
MAX_SIZE, MAX_SEPARATORS, MAX_SEPARATOR = 1_000_000, 16, 128
#: The greatest child that is cut by an expression: matching goes as deep as a child has changes between characters below and beyond U+10000.
REGEX_SIZE = 2000


@dataclass(frozen=True)
class ChunkingPolicy:
    size: int = 1000
    overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")
    splitter_version: str = "child-v1"
    heading_prefix_version: str = "heading-path-v1"

    def __post_init__(self):
        if not 0 < self.size <= MAX_SIZE or not 0 <= self.overlap < self.size:
            raise ValueError(f"size must be from 1 to {MAX_SIZE} and the overlap from 0 to below it")
        if not 1 <= len(self.separators) <= MAX_SEPARATORS or not all(isinstance(s, str) and len(s) <= MAX_SEPARATOR for s in self.separators):
            raise ValueError(f"separators must be 1 to {MAX_SEPARATORS} strings of up to {MAX_SEPARATOR} characters")


#: Lengths that are added up one by one; more are added up in groups of so many.
GROUP = 256


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: in lambda functions nothing else keeps it from being computed at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, policy: ChunkingPolicy) -> Column:
    """The text of more than policy.size characters from each child's end to the next, in order: what each child has beyond its overlap.

    A child that begins at a is cut in its later half after the last of the first separator that is there, else at its end. Its predecessor ended at
    a + overlap, so pieces are matches of one expression, each of bounded length, and a text is read once.
    """
    half = max(policy.overlap + 1, policy.size // 2)

    def piece(least: int, most: int) -> str:
        after = [f".{{{least},{most - len(s)}}}" + "".join(f"\\x{{{ord(c):x}}}" for c in s) for s in policy.separators if s and least <= most - len(s)]
        return "|".join([*after, f".{{{most}}}"])

    most = policy.size - policy.overlap
    return F.regexp_extract_all(text, F.lit(f"(?s)\\A(?:{piece(half, policy.size)})|.{{1,{most}}}+\\z|{piece(half - policy.overlap, most)}"), F.lit(0))


def _running(lengths: Column) -> Column:
    """0 and the sums of the first 1, 2, ... of them."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def _stops(pieces: Column) -> Column:
    """Where each piece ends. Sums go by groups, so that their cost doesn't grow with the square of a text's pieces."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / GROUP).cast("int")), lambda g: F.transform(F.slice(pieces, g * GROUP + 1, F.lit(GROUP)), lambda x: F.length(x)))
    before = lambda g: _running(F.transform(g, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)))
    return _let(groups, lambda g: _let(before(g), lambda b: F.flatten(F.transform(g, lambda x, i: F.slice(F.transform(_running(x), lambda y: y + F.get(b, i)), F.lit(2), F.size(x))))))


def bounds(text, policy: ChunkingPolicy = ChunkingPolicy(), content: bool = False) -> Column:
    """[start, end) of each child, from 0, as array<struct<start,stop>>, with its content if that is wanted; null for null, one empty child for an empty text."""
    text = F.col(text) if isinstance(text, str) else text
    size, overlap = policy.size, policy.overlap

    def child(start, stop, own):
        return F.struct(start.alias("start"), stop.alias("stop"), *([own().alias("content")] if content else []))

    def cut(t, pieces):
        # a piece that isn't the last has at least half - overlap characters; if that is an overlap, a child is made of two pieces, and else of the text
        near = max(overlap + 1, size // 2) - overlap >= overlap
        start = lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1) - overlap)
        tail = lambda p, i: F.when(i == 0, F.lit("")).otherwise(F.right(F.get(p, i - 1), F.lit(overlap)))
        own = lambda s, p, i: F.concat(tail(p, i), F.get(p, i)) if near else F.substring(t, start(s, i) + 1, F.get(s, i) - start(s, i))
        return _let(pieces, lambda p: _let(_stops(p), lambda s: F.transform(s, lambda stop, i: child(start(s, i), stop, lambda: own(s, p, i)))))

    whole = lambda t: F.when(F.length(t) <= size, F.array(child(F.lit(0), F.length(t), lambda: t))).otherwise(cut(t, _pieces(t, policy)))
    return _let(text, lambda t: F.when(t.isNotNull(), whole(t)))


def bounds_udf(policy: ChunkingPolicy = ChunkingPolicy()):
    """The same by an Arrow function, which gets texts whole, in batches of Spark's; the plain statement of the rule, for tests and for policies beyond REGEX_SIZE."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            at, found = 0, []
            while True:
                hard = at + policy.size
                stop = len(t)
                if hard < len(t):
                    low = at + max(policy.overlap + 1, policy.size // 2)
                    stop = next((k + len(s) for s in policy.separators if s and (k := t.rfind(s, low, hard)) >= 0), hard)
                found.append({"start": at, "stop": stop})
                if stop == len(t):
                    break
                at = stop - policy.overlap
            out.append(found)
        return pd.Series(out)

    return run


def children(sections: DataFrame, policy: ChunkingPolicy = ChunkingPolicy()) -> DataFrame:
    """sections (id, file, heading, heading_path, content) -> child records of twelve fields."""
    rows = sections.where("content IS NOT NULL").select("id", "file", "heading", "heading_path", normalize("content").alias("text")).withColumn("context", heading_context("heading_path", "heading"))
    if policy.size <= REGEX_SIZE:
        rows = rows.withColumn("cuts", bounds("text", policy, content=True))
    else:
        rows = rows.withColumn("ends", bounds_udf(policy)("text")).withColumn("cuts", F.transform("ends", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.substring(F.col("text"), c["start"] + 1, c["stop"] - c["start"]).alias("content"))))
    # each text has a child; posexplode() would have the cuts made twice, once to see that there are some
    rows = rows.select("*", F.size("cuts").alias("chunk_count")).select("*", F.posexplode_outer("cuts").alias("chunk_index", "cut"))
    rows = rows.withColumn("content", F.col("cut.content"))
    rows = rows.withColumn("embedding_text", embedded_text("context", "content"))
    return rows.select(F.concat("id", F.lit("::chunk-"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("id").alias("source_id"), "file", "heading", "heading_path", "chunk_index", "chunk_count", "content", "embedding_text", content_hash("embedding_text").alias("content_hash"), F.lit(policy.splitter_version).alias("splitter_version"), F.lit(policy.heading_prefix_version).alias("heading_prefix_version"), F.col("cut.start").alias("start"), F.col("cut.stop").alias("stop"))
