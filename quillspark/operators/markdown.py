"""Markdown files to heading-level sections, by windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import SPACE, section_slug, strip, tokenize

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
HEADING = rf"^(#{{1,6}}){SPACE}+(.+?){SPACE}*$"


def lines(files: DataFrame) -> DataFrame:
    """files (file, text) -> (file, pos, line, lvl, heading); lvl is null for lines that aren't headings."""
    rows = files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END, -1)).alias("pos", "line"))
    marks = F.regexp_extract("line", HEADING, 1)
    heading = strip(F.regexp_replace(strip(F.regexp_extract("line", HEADING, 2)), "^#+|#+$", ""))
    return rows.select("file", "pos", "line", F.when(marks != "", F.length(marks)).alias("lvl"), F.when(marks != "", heading).alias("heading"))


def heading_paths(rows: DataFrame) -> DataFrame:
    """Each line with the position of its heading (`at`), that heading's level, text and path.

    For every level the last heading so far; it is open unless a heading of a lower level came after it.
    """
    sofar = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.select("*", F.max(F.when(F.col("lvl").isNotNull(), F.struct("pos", "lvl", "heading"))).over(sofar).alias("own"), *[F.max(F.when(F.col("lvl") == k, F.struct("pos", "heading"))).over(sofar).alias(f"h{k}") for k in range(1, 7)])
    path = []
    for k in range(1, 7):
        live = F.col(f"h{k}").isNotNull()
        for j in range(1, k):
            live = live & (F.col(f"h{j}").isNull() | (F.col(f"h{j}.pos") < F.col(f"h{k}.pos")))
        path.append(F.when(live, F.col(f"h{k}.heading")))
    return last.select("file", "pos", "line", "lvl", F.col("own.pos").alias("at"), F.col("own.lvl").alias("at_lvl"), F.col("own.heading").alias("heading"), F.array_compact(F.array(*path)).alias("heading_path"))


def sections(files: DataFrame) -> DataFrame:
    """(id, file, heading, heading_path, content, tokens, pos): bodies under headings of level 2 to 6 that aren't empty."""
    rows = heading_paths(lines(files)).where("at_lvl > 1")
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("lvl").isNull(), F.struct("pos", "line")))), lambda x: x["line"])
    out = rows.groupBy("file", F.col("at").alias("pos")).agg(F.first("heading").alias("heading"), F.first("heading_path").alias("heading_path"), strip(F.array_join(body, "\n")).alias("content"))
    out = out.where("content <> ''").withColumn("slug", section_slug("heading"))
    nth = F.row_number().over(Window.partitionBy("file", "slug").orderBy("pos"))
    out = out.withColumn("id", F.concat("file", F.lit("#"), "slug", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise("")))
    return out.select("id", "file", "heading", "heading_path", "content", tokenize(F.concat_ws("\n", "heading_path", "content")).alias("tokens"), "pos")
