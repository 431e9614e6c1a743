"""From ranked sections to grounded answers: the gate, prompts, citations, payloads, the wiki index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import MIN_LEXICAL_SCORE, MIN_VECTOR_SCORE, preview, strip

#: The answer when nothing supports one, and how citations are written.
FALLBACK_ANSWER = "I cannot confirm from the knowledge base."
CITATION = r"\[Source: ([^\[\]\r\n]+)\]"
CITATION_LIKE = r"(?i)\[\s*source"
#: The greatest number of results, and the answer when there is no index.
MAX_K = 20


def valid_query(query) -> Column:
    """1 to 2000 characters besides white space at the ends, Unicode's included."""
    return F.coalesce(F.length(strip(query)).between(1, 2000), F.lit(False))


def valid_k(k) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return F.coalesce(k.between(1, MAX_K), F.lit(False))


def answerable(bm25_score="bm25_score", vector_score="vector_score") -> Column:
    return F.coalesce(F.col(bm25_score) >= MIN_LEXICAL_SCORE, F.lit(False)) | F.coalesce(F.col(vector_score) >= MIN_VECTOR_SCORE, F.lit(False))


def citations(answer="answer") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(CITATION), F.lit(1))


def malformed(answer="answer") -> Column:
    """Whether something looks like a citation and isn't one."""
    return F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), CITATION, "\x00").rlike(CITATION_LIKE)


def checked_citations(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, ranked array<string>): cited ids, whether all hold, and the ranked ids that are cited, in rank order."""
    rows = answers.withColumns({"cited": citations(), "malformed": malformed()})
    valid = (F.size("cited") > 0) & ~F.col("malformed") & (F.size(F.array_except("cited", "ranked")) == 0)
    sources = F.filter("ranked", lambda r: F.array_contains("cited", r))
    return rows.withColumn("valid", valid).withColumn("sources", F.when(F.col("valid"), sources).otherwise(F.array().cast("array<string>"))).withColumn("final_answer", F.when(F.col("valid"), F.col("answer")).otherwise(FALLBACK_ANSWER))


def source_payload() -> Column:
    """The struct that a hit is sent as; scores to six decimals."""
    six = lambda c: F.round(c, 6).alias(c)
    return F.struct(F.col("id").alias("source"), F.concat_ws(" > ", "heading_path").alias("heading"), six("score"), "content", "bm25_rank", "vector_rank", six("bm25_score"), six("vector_score"), six("rrf_score"), "rerank_rank", six("rerank_score"))


def prompts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt): the question and its ranked sections as JSON. hits: query_id, id, rank, heading_path, score, content; k rows per query."""
    section = F.struct("rank", F.struct(F.col("id").alias("source"), F.concat_ws(" > ", "heading_path").alias("heading"), F.round("score", 6).alias("score"), F.col("content").alias("text")).alias("s"))
    grouped = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]).alias("selected_sections"))
    return grouped.join(queries, "query_id").select("query_id", F.to_json(F.struct(F.col("query").alias("question"), "selected_sections"), {"ignoreNullFields": "false"}).alias("prompt"))


#: Fixed value: the answer where no index is there.
NOT_INDEXED_ANSWER = "The knowledge base has not been indexed yet. Call POST /index first."


def extractive(prompts: list[str]) -> list[str]:
    """The generator used where none is given: points to the best section."""
    import json

    return [f"See the source. [Source: {json.loads(p)['selected_sections'][0]['source']}]" for p in prompts]


def generated(prompted: DataFrame, generate, batch: int = 16) -> DataFrame:
    """prompted (query_id, prompt) with the answers of generate(list of prompts) -> list of texts. A call that fails, or gives another number
    of texts, gives null answers for its batch alone, which the citation check turns into the fallback."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                try:
                    got = list(generate(part.column("prompt").to_pylist()))
                except Exception:  # whatever the generator raises
                    got = []
                got = got if len(got) == part.num_rows else [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g if isinstance(g, str) else None for g in got], pa.string())], names=["query_id", "prompt", "answer"])

    return prompted.select("query_id", "prompt").mapInArrow(run, prompted.select("query_id", "prompt").schema.add("answer", "string"))


def chat(hits: DataFrame, queries: DataFrame, generate=extractive) -> DataFrame:
    """Gate, prompt, generate, check. hits: query_id, id, rank, score, bm25_score, vector_score, heading_path, content; k rows per query.

    Queries without an answerable hit get the fallback without a call.
    """
    kept = hits.where(answerable())
    ranked = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ranked"))
    answers = generated(prompts(kept, queries), generate)
    rows = queries.join(ranked, "query_id", "left").join(answers, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    return checked_citations(rows)


def not_indexed(queries: DataFrame) -> DataFrame:
    """What chat gives where there is no index."""
    none = F.array().cast("array<string>")
    return queries.select("query_id", "query", F.lit(NOT_INDEXED_ANSWER).alias("final_answer"), none.alias("sources"), F.lit(False).alias("indexed"))


def wiki_entries(sections: DataFrame) -> DataFrame:
    """(file, id, entry): a section's lines in the wiki index."""
    p = preview("content")
    entry = F.concat(F.lit("- ["), F.col("id"), F.lit("] — "), F.concat_ws(" > ", "heading_path"), F.when(p != "", F.concat(F.lit("\n  - "), p)).otherwise(""))
    return sections.select("file", "id", entry.alias("entry"))


def wiki_files(sections: DataFrame) -> DataFrame:
    """(file, text): each file's part of the wiki index, sections by id."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "entry"))), lambda x: x["entry"])
    return wiki_entries(sections).groupBy("file").agg(F.concat(F.lit("## "), F.first("file"), F.lit("\n\n"), F.array_join(listed, "\n"), F.lit("\n")).alias("text"))


def answer_cards(answers: DataFrame, model: str) -> DataFrame:
    """Cards to be written as JSON: schema_version, created_at, question, answer, sources, model."""
    return answers.select(F.lit(1).alias("schema_version"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("query").alias("question"), F.col("final_answer").alias("answer"), "sources", F.lit(model).alias("model"))
