"""JSON and text files that an index leaves for others to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import file_slug
from quillspark.operators import grounding, ranking

SECTIONS = "id string, file string, heading string, heading_path array<string>, content string, tokens array<string>"


def write_index(sections: DataFrame, path: str) -> None:
    """Sections and statistics, as JSON lines in folders of their own; the commit of each write is atomic."""
    sections.select("id", "file", "heading", "heading_path", "content", "tokens").sort("file", "id").write.mode("overwrite").json(f"{path}/sections")
    ranking.corpus_stats(sections).write.mode("overwrite").json(f"{path}/stats")
    ranking.document_frequency(sections).sort("token").write.mode("overwrite").json(f"{path}/doc_freq")


def read_index(spark: SparkSession, path: str, table: DataFrame | None = None) -> DataFrame:
    """The sections; a malformed line is an error. Where the table of sections is given and differs, the table wins."""
    found = spark.read.schema(SECTIONS).option("mode", "FAILFAST").json(f"{path}/sections")
    if table is None:
        return found
    table = table.select(found.columns)
    return found if same_rows(table, found) else table


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of the same columns have the same rows as often. Rows are compared by digest, so that their texts aren't shuffled."""
    digest = lambda df, n: df.select(F.unhex(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)).alias("row"), F.lit(n).alias("n"))
    return digest(a, 1).unionByName(digest(b, -1)).groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()


def write_wiki(sections: DataFrame, path: str) -> None:
    """One part of the wiki per file, in files' order."""
    grounding.wiki_files(sections).sort("file").select("text").write.mode("overwrite").text(path)


def write_answer_cards(answers: DataFrame, path: str, model: str) -> None:
    """Appends cards, each in a folder of its name (time and question); Spark names files uniquely, so none is overwritten."""
    cards = grounding.answer_cards(answers, model)
    name = F.concat(F.regexp_replace("created_at", "[-:]", ""), F.lit("-"), file_slug("question"))
    cards.withColumn("name", name).write.mode("append").partitionBy("name").json(path)
