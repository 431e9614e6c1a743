"""Build an index from a directory, reusing what hasn't changed."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import tokenize
from quillspark.operators import chunking, identity, incremental, markdown, ranking
from quillspark.plans.search import DenseUnavailable
from quillspark.sources import index_store, markdown_files


def ordered(sections: DataFrame) -> DataFrame:
    """Sections in order of file and id. Texts are shuffled for it once, without their tokens, which are found again where a text arrives."""
    return sections.drop("tokens").sort("file", "id").withColumn("tokens", tokenize(F.concat_ws("\n", "heading_path", "content"))).select(sections.columns)


def search_tables() -> dict:
    """What a search reads, each from the tables before it: children, both rankers' postings and terms, statistics."""
    return {
        "children": lambda t: chunking.children(t["sections"]),
        "stats": lambda t: ranking.corpus_stats(t["sections"]),
        "postings": lambda t: ranking.lexical_postings(t["sections"]),
        "terms": lambda t: ranking.lexical_terms(t["postings"], t["stats"]),
        "child_counts": lambda t: ranking.child_counts(ranking.child_tokens(t["children"])),
        "child_terms": lambda t: ranking.vector_terms(t["child_counts"], t["children"].agg(F.count("*").alias("n"))),
        "child_postings": lambda t: ranking.vector_postings(t["child_counts"], t["child_terms"]),
    }


def bag_tables(sections: DataFrame) -> dict:
    """What plans.search.Batch reads beside sections: children's counts, one row per term, norms."""
    kids = ranking.child_tokens(chunking.children(sections)).select("id", "source_id", "tokens")
    return {
        "child_bags": ranking.child_bags(kids),
        "child_terms": lambda t: ranking.vector_terms(t["child_bags"].select(F.explode("terms.token").alias("token")), t["child_bags"].agg(F.count("*").alias("n"))),
        "child_norms": lambda t: ranking.child_norms(ranking.bag_counts(t["child_bags"]), t["child_terms"]),
    }


def index_tables(files: DataFrame, sections: DataFrame) -> dict:
    return {"files": files, "sections": ordered(sections), **search_tables()}


#: Settings under which a stored index may be gone on with.
def settings(policy: chunking.ChunkingPolicy = chunking.ChunkingPolicy()) -> dict:
    return {"policy": {**asdict(policy), "separators": list(policy.separators)}}


def reindex(spark: SparkSession, directory: str, root: str) -> dict[str, int]:
    """Parse changed files, keep sections of skipped ones, drop those of deleted ones; writes the next generation. Returns the counts.

    Files are read once into the new generation's own tables, and it is made current only if the directory still is what was read. An index of
    other settings is not gone on with: all files count as changed.
    """
    raw = markdown_files.scan(spark, directory)
    old = index_store.load(spark, root)
    if old and not index_store.compatible(index_store.manifest(spark, root, index_store.current(spark, root)), {"version": index_store.VERSION, "meta": settings()}):
        old = {}
    taken = f"{root}/taken-{uuid.uuid4().hex}"
    raw.write.parquet(taken)  # one reading: what is compared is what is parsed
    try:
        raw = spark.read.schema(raw.schema).parquet(taken)
        now = markdown_files.snapshot(raw)
        diff = incremental.index_diff(old["files"] if old else spark.createDataFrame([], now.schema), now).persist()
        stats = incremental.run_stats(diff).first().asDict()
        if not old or stats["changed"] or stats["deleted"]:
            changed = raw.join(diff.where("status = 'changed'").select("path"), "path", "left_semi")
            fresh = markdown.sections(markdown_files.texts(changed))
            keep = old["sections"].join(diff.where("status = 'skipped'").select(F.col("path").alias("file")), "file", "left_semi").select(fresh.columns) if old else None
            still = lambda _: _unchanged(now, markdown_files.snapshot(markdown_files.scan(spark, directory)))
            index_store.save(spark, root, index_tables(now, fresh if keep is None else keep.unionByName(fresh)), settings(), activate=still)
        diff.unpersist()
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(taken)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return stats


def _unchanged(was: DataFrame, now: DataFrame) -> bool:
    return incremental.index_diff(was, now).where("status <> 'skipped'").isEmpty()


def dense_tables(children: DataFrame, vectors: DataFrame) -> dict:
    """A dense generation: children as they were embedded, and their vectors (chunk_id, vector) of length 1."""
    return {"children": children, "vectors": lambda t: ranking.unit(vectors.join(t["children"].select("chunk_id", "source_id"), "chunk_id").select("chunk_id", "source_id", "vector"))}


def save_dense(spark: SparkSession, root: str, children: DataFrame, vectors: DataFrame, namespace: identity.Namespace) -> str:
    """Write a dense index and make it current if each child has one vector of the dimension."""
    counts = children.agg(F.count("*"), F.countDistinct("source_id"), F.countDistinct("file")).first()
    meta = {"chunks": counts[0], "sections": counts[1], "files": counts[2], "dimension": namespace.resolved_dimension, "namespace": namespace.fingerprint, "corpus": identity.corpus_fingerprint(identity.child_identity(children))}

    def whole(_):
        good = vectors.where(F.size("vector") == namespace.resolved_dimension).select("chunk_id")
        return children.select("chunk_id").exceptAll(good).isEmpty() and good.exceptAll(children.select("chunk_id")).isEmpty()

    return index_store.save(spark, root, dense_tables(children, vectors), meta, activate=whole)


def load_dense(spark: SparkSession, root: str, children: DataFrame, namespace: identity.Namespace) -> DataFrame:
    """The stored vectors, if their manifest agrees with the children and the namespace; DenseUnavailable otherwise."""
    gen = index_store.current(spark, root)
    if gen is None:
        raise DenseUnavailable("there is no dense index")
    try:
        identity.check_manifest(index_store.manifest(spark, root, gen)["meta"], children, namespace)
    except ValueError as e:
        raise DenseUnavailable(str(e)) from e
    return index_store.load(spark, root, gen)["vectors"]
