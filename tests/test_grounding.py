import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import grounding

RANKED = ["a", "b", "c"]


@pytest.mark.parametrize(
    "answer,sources",
    [
        ("x [Source: b] y [Source: a]", ["a", "b"]),
        ("[Source: a][Source: a]", ["a"]),
        ("no citation", []),
        ("", []),
        (None, []),
        ("[source: a]", []),
        ("[Source: a] and [ SOURCE b", []),
        ("[Source: a] [Source: z]", []),
        ("[Source: ]", []),
    ],
)
def test_citations(spark, answer, sources):
    df = spark.createDataFrame([(1, answer, RANKED)], "query_id int, answer string, ranked array<string>")
    r = grounding.checked_citations(df).first()
    assert r["sources"] == sources
    assert r["final_answer"] == (answer if sources else grounding.FALLBACK_ANSWER)


def test_gate(spark):
    rows = [(0.75, None, True), (None, 0.01, False), (0.74, 0.05, True), (None, None, False)]
    df = spark.createDataFrame(rows, "bm25_score double, vector_score double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", grounding.answerable()).collect())


def test_valid_query(spark):
    df = spark.createDataFrame([("x",), (" ",), ("",), ("y" * 2000,), ("y" * 2001,), (None,)], "q string")
    assert [r[0] for r in df.select(grounding.valid_query("q")).collect()] == [True, False, False, True, False, False]


def test_chat_falls_back(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    hits = spark.createDataFrame([(1, "a", 1, 0.9, None, 0.5, ["T"], "c"), (2, "b", 1, 0.1, 0.01, 0.5, ["T"], "c")], "query_id int, id string, rank int, bm25_score double, vector_score double, score double, heading_path array<string>, content string")
    got = {r["query_id"]: (r["sources"], r["final_answer"]) for r in grounding.chat(hits, q).collect()}
    assert got[1] == (["a"], "See the source. [Source: a]") and got[2] == ([], grounding.FALLBACK_ANSWER)


def test_prompt(spark):
    q = spark.createDataFrame([(1, "why é?")], "query_id int, query string")
    hits = spark.createDataFrame([(1, "b", 2, 0.1234567, ["T", "B"], "text b"), (1, "a", 1, 0.5, ["T"], "text a")], "query_id int, id string, rank int, score double, heading_path array<string>, content string")
    got = json.loads(grounding.prompts(hits, q).first()["prompt"])
    assert got == {"question": "why é?", "selected_sections": [{"source": "a", "heading": "T", "score": 0.5, "text": "text a"}, {"source": "b", "heading": "T > B", "score": 0.123457, "text": "text b"}]}


def test_wiki(spark):
    s = spark.createDataFrame([("f.md#b", "f.md", ["T", "B"], " two\n lines "), ("f.md#a", "f.md", ["T", "A"], "")], "id string, file string, heading_path array<string>, content string")
    assert grounding.wiki_files(s).first()["text"] == "## f.md\n\n- [f.md#a] — T > A\n- [f.md#b] — T > B\n  - two lines\n"


def test_payload_has_all_fields(spark):
    none = {c: F.lit(None).cast("double") for c in ("bm25_score", "vector_score", "rrf_score", "rerank_score")} | {c: F.lit(None).cast("int") for c in ("bm25_rank", "vector_rank", "rerank_rank")}
    df = spark.createDataFrame([("a", ["T"], 0.1234567, "c")], "id string, heading_path array<string>, score double, content string").withColumns(none)
    p = df.select(grounding.source_payload().alias("p")).first()["p"]
    assert (p["source"], p["heading"], p["score"], p["bm25_rank"]) == ("a", "T", 0.123457, None)


def test_answer_cards(spark):
    df = spark.createDataFrame([("q", "a", ["s"])], "query string, final_answer string, sources array<string>")
    assert grounding.answer_cards(df, "m").columns == ["schema_version", "created_at", "question", "answer", "sources", "model"]


def test_white_space_is_no_question(spark):
    texts = ["", " ", "\n", "\t \n", "\u3000\u00a0", "a", " a \n", "x" * 2000, "x" * 2001, "\n" + "x" * 2000 + "\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, q string")
    got = [r["v"] for r in df.select("k", grounding.valid_query("q").alias("v")).orderBy("k").collect()]
    assert got == [len((t or "").strip()) in range(1, 2001) for t in texts]
    ks = spark.createDataFrame([(k,) for k in (-1, 0, 1, 20, 21, None)], "k int")
    assert [r["v"] for r in ks.select(grounding.valid_k("k").alias("v")).collect()] == [False, False, True, True, False, False]


def test_cards_are_dated_in_utc(spark):
    import datetime

    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("q", "a", ["s"])], "query string, final_answer string, sources array<string>")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        made = datetime.datetime.strptime(grounding.answer_cards(df, "m").first()["created_at"], "%Y-%m-%dT%H:%M:%SZ")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None) - made) < datetime.timedelta(minutes=5)


def test_generators_get_prompts_and_may_fail(spark):
    q = spark.createDataFrame([(k, f"question {k}") for k in range(4)], "query_id int, query string")
    hits = spark.createDataFrame([(k, f"s{k}", 1, 0.9, None, 0.5, ["T"], "c") for k in range(3)], "query_id int, id string, rank int, bm25_score double, vector_score double, score double, heading_path array<string>, content string").coalesce(1)

    def generate(prompts):
        if any("question 1" in p for p in prompts):
            raise OSError("away")
        return [f"Yes [Source: {json.loads(p)['selected_sections'][0]['source']}]" for p in prompts]

    one = lambda prompts: [generate([p])[0] for p in prompts]
    got = {r["query_id"]: (r["sources"], r["final_answer"]) for r in grounding.chat(hits, q, one).collect()}
    assert set(got) == {0, 1, 2, 3} and got[1] == got[3] == ([], grounding.FALLBACK_ANSWER)
    assert all(got[k] in (([f"s{k}"], f"Yes [Source: s{k}]"), ([], grounding.FALLBACK_ANSWER)) for k in (0, 2))
    assert [r["final_answer"] for r in grounding.not_indexed(q).collect()] == [grounding.NOT_INDEXED_ANSWER] * 4
