"""A training corpus from raw documents: STAGES in order, each over all that its predecessor kept.

Documents are carried whole (as a struct) past the operators, so extra columns stay and none can clash with an operator's own. Stages that
must tell rows apart write them with a number of their own first, as ids may lack or repeat.
Defined results: an empty table passes every stage as an empty table; null text is empty text, which the quality rules reject; very
long texts go through whole; of linked rows the one of least id stays, rows with an id before those without, then any one; rows
without words stay, but of those of equal id and text one; repeated rows are mixed as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, mixing, ngram_join, quality_rules, toxicity
from quillspark.llm.common import dropped, table, written


def _numbered(docs: DataFrame) -> DataFrame:
    """(place, row) as a table: numbers that stay with their rows in every later scan."""
    return written(docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*docs.columns).alias("row")), "numbered")


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from labels of documents at hand."""
    model = toxicity.trained(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", toxicity.fit)
    return toxicity.score_texts(_whole(docs, "text"), model, ["row"]).where(F.col("score") < toxicity.REJECT).select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(_whole(docs, "text", "lang")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of least id stays."""
    rows = _numbered(docs)
    found = ngram_join.linked(rows.select(F.col("place").alias("doc_id"), "row.text")).withColumnRenamed("doc_id", "place")
    text = F.md5(F.coalesce("row.text", F.lit("\0")).cast("binary"))
    ids = rows.select("place", "row.doc_id", F.when(ngram_join.is_blank("row.text"), text).alias("blank"))
    stay = found.join(ids, "place").groupBy(F.when(F.col("blank").isNull(), F.col("component_id")).alias("component"), F.when(F.col("blank").isNotNull(), F.col("doc_id")).alias("id"), "blank")
    stay = stay.agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "place")).alias("least"))
    return rows.join(stay.select("least.place"), "place", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Only ids and sizes are sampled; texts are joined once, by the rows' numbers."""
    rows = _numbered(docs)
    taken = mixing.mixed(rows.select("row.doc_id", "row.text", "row.source", "place"), keep=["place"]).where("copies > 0").select("place", "copies")
    return rows.join(taken, "place").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: their number and digest, and the digest of what they decode to."""
    import public_tokenizers

    coded = byte_bpe.encode_documents(docs, byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, keep=["lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: The stages learn, hash and tokenise by rules that DuckDB SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:  # never the source table
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
