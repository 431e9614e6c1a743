"""Search plans: both rankers once per batch of queries, and the four stages derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import grounding, ranking
from quillspark.operators.grounding import MAX_K, valid_query
from quillspark.sources import index_store


def depth(k: int) -> int:
    """How many hits of each ranker are fused for k results."""
    return max(4 * k, 10)


class DenseUnavailable(Exception):
    """Raised by a dense ranker that can't serve (no index, other settings, provider out of reach): TF-IDF serves instead."""


class Search:
    """Over the tables of an index (plans.build.search_tables and sections), stored or not, for a batch of queries (query_id, query).

    dense, if given, is asked first for hits of children: dense(queries) -> (query_id, id, score). Only DenseUnavailable makes it
    give way to TF-IDF; any other error is one. `backend` says which served.

    lexical() and vector() are as deep as up to `k` results need and each computed once, into a checkpoint of a few hundred rows a query;
    everything else follows from them.
    """

    indexed = True

    def __init__(self, index: dict[str, DataFrame], queries: DataFrame, dense=None, k: int = MAX_K):
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must be from 1 to {MAX_K}")
        self.index, self.queries, self.dense, self.k, self.backend = index, queries.where(valid_query("query")), dense, k, None
        self.sections, self.most = index["sections"], depth(depth(k))
        self._lexical = self._vector = None

    @classmethod
    def over(cls, sections: DataFrame, children: DataFrame, queries: DataFrame, dense=None, k: int = MAX_K) -> Search:
        """Without a stored index: sections (id, file, heading_path, content, tokens) and tokens of their children (id, source_id, tokens)."""
        lexical, vector = ranking.lexical_index(sections), ranking.vector_index(children)
        parents = children.select(F.col("id").alias("chunk_id"), "source_id")
        return cls({"sections": sections, "children": parents, "postings": lexical["postings"], "terms": lexical["terms"], "child_postings": vector["postings"], "child_terms": vector["terms"]}, queries, dense, k)

    @classmethod
    def opened(cls, spark: SparkSession, root: str, queries: DataFrame, dense=None, k: int = MAX_K) -> Search:
        """Over the current generation at root. Where there is none, searches find nothing and chat() says that nothing is indexed."""
        index = index_store.load(spark, root)
        if index:
            return cls(index, queries, dense, k)
        sections = spark.createDataFrame([], "id string, file string, heading string, heading_path array<string>, content string, tokens array<string>")
        none = cls.over(sections, spark.createDataFrame([], "id string, source_id string, tokens array<string>"), queries, None, k)
        none.indexed = False
        return none

    @staticmethod
    def _once(df: DataFrame) -> DataFrame:
        index_store.shared_folder(df.sparkSession)
        return df.checkpoint()

    def lexical(self) -> DataFrame:
        if self._lexical is None:
            index_store.shared_folder(self.queries.sparkSession)
            self._lexical = self._once(ranking.bm25_best(self.index["postings"], self.index["terms"], self.queries, self.most))
        return self._lexical

    def vector(self) -> DataFrame:
        if self._vector is None:
            index_store.shared_folder(self.queries.sparkSession)
            hits = self._parents()  # settles the backend
            self._vector = self._once(hits.withColumn("backend", F.lit(self.backend)))
        return self._vector

    def _parents(self) -> DataFrame:
        if self.dense is not None:
            try:
                hits = self.dense(self.queries).select("query_id", "id", "score")
                self.backend = "dense"
                parents = self.index["children"].select(F.col("chunk_id").alias("id"), "source_id")
                return ranking.ranked(ranking.best_parent(hits, parents).join(self.sections.select("id"), "id", "left_semi"), self.most)
            except DenseUnavailable:
                pass
        self.backend = "tfidf"
        return self._sparse()

    def _sparse(self) -> DataFrame:
        # children of an index have their parents in it
        return ranking.cosine_best(self.index["child_postings"], self.index["child_terms"], self.queries, self.most, parents=True)

    def fused(self, k: int) -> DataFrame:
        return self._fused(self._checked(k))

    def _checked(self, k: int) -> int:
        if not 1 <= k <= self.k:
            raise ValueError(f"k must be from 1 to {self.k}")
        return k

    def _fused(self, k: int) -> DataFrame:
        d = depth(k)
        return ranking.rrf(self.lexical().where(F.col("rank") <= d), self.vector().where(F.col("rank") <= d), k)

    def reranked(self, k: int) -> DataFrame:
        return ranking.reranked(ranking.rerank_features(self._once(self._fused(depth(self._checked(k))).drop("rank")), self.sections, self.queries), k)

    def with_texts(self, hits: DataFrame) -> DataFrame:
        """Hits with their sections' heading_path and content. No other section's text is shuffled for it."""
        hits = self._once(hits)
        texts = self.sections.select("id", "heading_path", "content").join(ranking.small(hits.select("id").distinct()), "id", "left_semi")
        return hits.join(texts, "id")

    def chat(self, generate=None, k: int = 3) -> DataFrame:
        """Search, gate, prompt, generate and check as one plan; one row per valid query (query_id, query, prompt, answer, sources, final_answer ...)."""
        if not self.indexed:
            return grounding.not_indexed(self.queries)
        hits = self.with_texts(self.reranked(k)).withColumns({"rank": F.col("rerank_rank"), "score": F.col("rerank_score")})
        return grounding.chat(hits, self.queries, generate or grounding.extractive)

    def compare(self, k: int = 3) -> DataFrame:
        """(query_id, stage, pos, id, score and the rankers' own) of all four stages."""
        none = {"bm25_rank": "int", "vector_rank": "int", "bm25_score": "double", "vector_score": "double", "rrf_score": "double", "rerank_rank": "int", "rerank_score": "double"}

        def stage(name, df, pos, score):
            own = {c: F.col(c) if c in df.columns else F.lit(None) for c in none}
            return df.select("query_id", F.lit(name).alias("stage"), F.col(pos).alias("pos"), "id", F.col(score).alias("score"), *[own[c].cast(t).alias(c) for c, t in none.items()])

        stages = [stage("lexical", self.lexical().where(F.col("rank") <= k), "rank", "score"), stage("vector", self.vector().where(F.col("rank") <= k), "rank", "score"), stage("hybrid", self.fused(k), "rank", "rrf_score"), stage("reranked", self.reranked(k), "rerank_rank", "rerank_score")]
        return reduce(DataFrame.unionByName, stages)


class Batch(Search):
    """The same over sections for which no postings are stored: the lexical ranker counts what the batch asks for where it reads a text, the vector
    ranker has children's counts as arrays (build.bag_tables), with one row per term and one norm per child. An index of postings shuffles and
    writes each posting several times, which a batch that reads it once doesn't gain from."""

    def lexical(self) -> DataFrame:
        if self._lexical is None:
            index_store.shared_folder(self.queries.sparkSession)
            self._lexical = self._once(ranking.bm25_batch(self.sections, self.queries, self.most))
        return self._lexical

    def _sparse(self) -> DataFrame:
        return ranking.cosine_batch(self.index["child_bags"], self.index["child_terms"], self.index["child_norms"], self.queries, self.most, parents=True)
