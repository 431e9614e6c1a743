import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunking, incremental, markdown, ranking
from quillspark.plans import build
from quillspark.plans.search import Batch, DenseUnavailable, Search
from quillspark.sources import index_store

FILES = [
    ("refund_policy.md", "# Refund Policy\n\n## Refund Timeline\n\nRefunds take five to seven business days.\n\n## Late Refunds\n\nContact support about late refunds."),
    ("account_help.md", "# Account Help\n\n## Change Email Address\n\nYou can change your email address in settings.\n\n## Reset Password\n\nUse the reset link."),
    ("shipping_faq.md", "# Shipping FAQ\n\n## Standard Shipping\n\nStandard shipping takes three days.\n\n## Express Shipping\n\nExpress arrives the next day."),
]
QUESTIONS = {0: "How long do refunds take?", 1: "Can I change my email address?", 2: "How long does standard shipping take?", 3: "Which restaurants are nearby?"}
TOP = {0: "refund_policy.md#refund-timeline", 1: "account_help.md#change-email-address", 2: "shipping_faq.md#standard-shipping"}


@pytest.fixture(scope="module")
def parts(spark):
    sections = markdown.sections(spark.createDataFrame(FILES, "file string, text string")).persist()
    queries = spark.createDataFrame(list(QUESTIONS.items()), "query_id long, query string")
    return sections, ranking.child_tokens(chunking.children(sections)), queries


def test_golden_tops(parts):
    s = Search.over(*parts)
    lexical = {r["query_id"]: r["id"] for r in s.lexical().where("rank = 1").collect()}
    top = {r["query_id"]: r for r in s.reranked(3).where("rerank_rank = 1").collect()}
    assert lexical == TOP and {q: r["id"] for q, r in top.items()} == TOP
    assert all(r["bm25_rank"] == 1 and r["vector_rank"] is not None for r in top.values()) and s.backend == "tfidf"
    stages = {(r["stage"], r["query_id"]) for r in s.compare(3).collect()}
    assert {q for _, q in stages} == {0, 1, 2} and {n for n, _ in stages} == {"lexical", "vector", "hybrid", "reranked"}


def test_dense_serves_or_gives_way(parts):
    sections, kids, queries = parts
    hit = lambda q: q.where("query_id = 0").select("query_id", F.lit("account_help.md#reset-password::chunk-0").alias("id"), F.lit(0.9).alias("score"))
    s = Search.over(sections, kids, queries, hit)
    assert [(r["id"], r["backend"]) for r in s.vector().collect()] == [("account_help.md#reset-password", "dense")] and s.backend == "dense"

    def away(_):
        raise DenseUnavailable

    s = Search.over(sections, kids, queries, away)
    assert s.vector().count() > 0 and s.backend == "tfidf"

    def broken(_):
        raise RuntimeError("not expected")

    with pytest.raises(RuntimeError):
        Search.over(sections, kids, queries, broken).vector()


def test_results_go_up_to_twenty(parts):
    s = Search.over(*parts)
    assert s.reranked(20).count() >= s.reranked(3).count() > 0
    for k in (0, 21, -1):
        with pytest.raises(ValueError):
            s.fused(k)
    with pytest.raises(ValueError):
        Search.over(*parts, k=3).fused(4)


def test_a_stored_index_gives_the_same_and_invalid_queries_nothing(spark, parts, tmp_path):
    sections, kids, queries = parts
    index_store.save(spark, str(tmp_path), {"sections": sections, **build.search_tables()})
    stored = index_store.load(spark, str(tmp_path))
    more = queries.unionByName(spark.createDataFrame([(9, " \n"), (10, None)], "query_id long, query string"))
    s = Search(stored, more)
    rows = lambda df: sorted(map(str, df.select("query_id", "stage", "pos", "id", F.round("score", 9)).collect()))
    assert rows(s.compare(3)) == rows(Search.over(*parts).compare(3))
    chat = {r["query_id"]: r["sources"] for r in s.chat().collect()}
    assert chat == {0: [TOP[0]], 1: [TOP[1]], 2: [TOP[2]], 3: []}
    plan = ranking.bm25_search(stored["postings"], stored["terms"], queries)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [isnotnull(bucket" in plan.replace("#", "") or "dynamicpruning" in plan


def test_dense_generations_are_checked_when_loaded(spark, parts, tmp_path):
    from quillspark.operators.identity import Namespace
    from quillspark.sources import embeddings

    sections, _, queries = parts
    kids, p = chunking.children(sections), embeddings.HashProvider(32)
    none = incremental.cache_rows(spark.createDataFrame([], "chunk_id string, source_id string, content_hash string, vector array<float>"), "x")
    vectors, name, root = embeddings.embedded(kids, none, p).select("chunk_id", "vector"), embeddings.namespace_of(p), str(tmp_path / "dense")
    with pytest.raises(DenseUnavailable):
        build.load_dense(spark, root, kids, name)
    build.save_dense(spark, root, kids, vectors, name)
    assert build.load_dense(spark, root, kids, name).count() == kids.count()
    with pytest.raises(DenseUnavailable):
        build.load_dense(spark, root, kids.where("file <> 'shipping_faq.md'"), name)
    with pytest.raises(DenseUnavailable):
        build.load_dense(spark, root, kids, Namespace("other", "m", "http://x", 32))
    with pytest.raises(RuntimeError):
        build.save_dense(spark, root, kids, vectors.limit(1), name)


def test_where_nothing_is_indexed(spark, parts, tmp_path):
    from quillspark.operators.grounding import NOT_INDEXED_ANSWER

    s = Search.opened(spark, str(tmp_path / "none"), parts[2])
    assert s.compare(3).count() == 0 and s.reranked(3).count() == 0
    assert {(r["query_id"], r["final_answer"], r["indexed"]) for r in s.chat().collect()} == {(q, NOT_INDEXED_ANSWER, False) for q in QUESTIONS}
    index_store.save(spark, str(tmp_path / "some"), {"sections": parts[0], **build.search_tables()})
    assert Search.opened(spark, str(tmp_path / "some"), parts[2]).compare(3).count() > 0


def test_best_of_equals_all_scores_ranked(spark, monkeypatch):
    """Ties, many queries, few cells a matrix, blocks of queries, parents."""
    import random

    pick = random.Random(6)
    words = [f"w{k}" for k in range(25)]
    rows = [(f"c{k:03}", f"p{k // 3:03}", t, float(pick.randint(1, 3))) for k in range(300) for t in pick.sample(words, pick.randint(1, 8))]
    asked = [(q, t, float(pick.randint(1, 2))) for q in range(40) for t in pick.sample([*words, "none"], 4)]
    postings, weights = spark.createDataFrame(rows, "id string, source_id string, token string, impact double").repartition(5), spark.createDataFrame(asked, "query_id long, token string, weight double")
    scores, best = {}, {}
    for c, p, t, x in rows:
        for q, w, y in asked:
            if t == w:
                scores[q, c, p] = scores.get((q, c, p), 0) + x * y
    for (q, c, p), s in scores.items():
        best[q, p] = max(best.get((q, p), 0), s)
    children = {(q, c): s for (q, c, p), s in scores.items()}

    def first(found, k):
        return sorted((q, i, s, n) for q in range(40) for n, (s, i) in enumerate(sorted(((s, i) for (x, i), s in found.items() if x == q), key=lambda z: (-z[0], z[1]))[:k], 1))

    for cells, pairs, most in ((1 << 22, 1 << 20, 500_000), (200, 50, 500_000), (200, 50, 60)):
        monkeypatch.setattr(ranking, "CELLS", cells)
        monkeypatch.setattr(ranking, "PAIRS", pairs)
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", most)
        index_store.shared_folder(spark)
        for found, parents in ((children, False), (best, True)):
            got = sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in ranking.best_of(postings, weights, 7, parents).collect())
            assert got == first(found, 7)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_batch_without_postings_gives_the_same(spark, parts, monkeypatch):
    """Also where terms are too many to be broadcast; and counting shuffles nothing."""
    sections, kids, queries = parts
    rows = lambda df: sorted(map(str, df.select("query_id", "stage", "pos", "id", F.round("score", 9)).collect()))
    want = rows(Search.over(*parts).compare(3))
    index_store.shared_folder(spark)
    for most in (500_000, 3):
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", most)
        tables = {}
        for name, df in build.bag_tables(sections).items():
            tables[name] = (df(tables) if callable(df) else df).persist()
        assert rows(Batch({"sections": sections, **tables}, queries).compare(3)) == want
    plain = spark.createDataFrame([("a", "f", "h", ["h"], "refund mail refund"), ("b", "f", "h", [], "")], "id string, file string, heading string, heading_path array<string>, content string").withColumn("tokens", tx.tokenize("content"))
    assert _exchanges(ranking.lexical_postings(plain)) == 0 and _exchanges(ranking.child_counts(ranking.child_tokens(chunking.children(plain)))) == 0
    assert {(r["id"], r["token"], r["tf"]) for r in ranking.lexical_postings(plain).collect()} == {("a", "refund", 2), ("a", "mail", 1)}


def test_parents_split_over_partitions_and_documents_out_of_order(spark):
    index_store.shared_folder(spark)
    rows = [("p2::chunk-0", "p2", "w", 1.0), ("p1::chunk-1", "p1", "w", 3.0), ("p0::chunk-0", "p0", "w", 3.0), ("p1::chunk-0", "p1", "w", 2.0)]
    postings = spark.createDataFrame(rows, "id string, source_id string, token string, impact double").coalesce(1)
    weights = spark.createDataFrame([(1, "w", 1.0)], "query_id long, token string, weight double")
    assert [(r["id"], r["score"]) for r in ranking.best_of(postings, weights, 1, whole=True).collect()] == [("p0::chunk-0", 3.0)]
    halves = postings.where("id <> 'p1::chunk-1'").unionByName(postings.where("id = 'p1::chunk-1'"))
    assert [(r["id"], r["score"]) for r in ranking.best_of(halves, weights, 2, True, whole=True).orderBy("rank").collect()] == [("p0", 3.0), ("p1", 3.0)]


def test_texts_are_sorted_without_tokens(spark, sf):
    """Tokens are found again after the exchange; and of stored sections digests are sorted, not texts."""
    from quillspark import queries

    sections = queries.sections(spark, sf)
    rows = build.ordered(sections)
    above, below = rows._jdf.queryExecution().executedPlan().toString().split("Exchange rangepartitioning")
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below
    assert rows.schema == sections.schema and rows.collect() == sections.sort("file", "id").collect()
    above, below = queries.stored_sections(spark, sf)._jdf.queryExecution().executedPlan().toString().split("Exchange rangepartitioning")
    assert "sha2" in below and "sha2" not in above


def test_a_child_goes_to_its_norm_as_one_row(spark, monkeypatch):
    """Of counts, only those of asked tokens, as numbers; and a task hands on the best of all its matrices, whether held back or not."""
    import random

    import pyarrow as pa

    index_store.shared_folder(spark)
    pick = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    rows = [(f"c{k:03}", f"p{k // 3:03}", pick.choices(words, k=pick.randint(0, 9))) for k in range(400)]
    tokens = spark.createDataFrame(rows, "id string, source_id string, tokens array<string>").repartition(3)
    bags = ranking.child_bags(tokens)
    terms = ranking.vector_terms(bags.select(F.explode("terms.token").alias("token")), tokens.agg(F.count("*").alias("n"))).persist()
    norms = ranking.child_norms(ranking.bag_counts(bags), terms)
    got = {r["id"]: dict(zip(r["places"], r["counts"])) for r in ranking.asked_bags(bags, pa.array(["w3", "none", "w7"])).collect()}
    want = {i: {at: t.count(w) for at, w in ((0, "w3"), (2, "w7")) if w in t} for i, _, t in rows}
    assert got == {i: x for i, x in want.items() if x}
    queries = spark.createDataFrame([(q, " ".join(pick.choices(words, k=4))) for q in range(25)], "query_id long, query string")
    index = ranking.vector_index(tokens)
    out = lambda df: [(r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]
    for parents in (False, True):
        best = out(ranking.cosine_best(index["postings"], index["terms"], queries, 5, parents))
        for cells, held, most in ((1 << 20, 1 << 18, 500_000), (300, 1 << 18, 500_000), (300, 130, 500_000), (300, 1, 500_000), (300, 1 << 18, 60)):
            monkeypatch.setattr(ranking, "CELLS", cells)
            monkeypatch.setattr(ranking, "PAIRS", cells)
            monkeypatch.setattr(ranking, "HELD", held)
            monkeypatch.setattr(ranking, "BROADCAST_ROWS", most)
            assert out(ranking.cosine_batch(bags, terms, norms, queries, 5, parents)) == best
        monkeypatch.undo()
