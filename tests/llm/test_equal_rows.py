"""Rows of one id or of none, blank rows beside texts, and inline parts of pages."""

import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspark.llm import html_extract, mixing, ngram_join, sharding
from quillspark.llm.queries import ORACLE_SQL, QUERIES


def _documents(folder, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] if len(r) > 2 else "s" for r in rows], pa.string())}), f"{folder}/documents.parquet", row_group_size=500)
    return str(folder)


# op 5


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def _components(rows):
    """Least id of all rows that links reach, by all pairs; blank rows link nothing."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)].append(d)
    return sorted((d, len(sets[k]), min(least[top(k)], default=d)) for k, (d, _) in enumerate(rows))


def test_blank_rows_that_share_an_id_link_nothing(spark, tmp_path):
    words = [f"w{k}" for k in range(124)]
    a, b = " ".join(words), " ".join(words[:100] + [f"v{k}" for k in range(24)])  # alike, but not enough
    rows = [(1, a), (1, ""), (2, b), (2, None), (3, " \n "), (3, a + " more"), (4, None), (4, ""), (5, "few words"), (5, "")]
    assert 50 < 100 * len(_shingles(a) & _shingles(b)) / len(_shingles(a) | _shingles(b)) < 75
    got = sorted(tuple(r) for r in QUERIES["op5_ngram_join"](spark, _documents(tmp_path, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == _components(rows)


def test_enough_needs_something_in_common():
    assert not ngram_join.enough(0, 0, 0) and not ngram_join.enough(0, 1, 0) and ngram_join.enough(3, 4, 3) and not ngram_join.enough(2, 4, 2)


# op 6


@pytest.mark.parametrize("of_none", [0.5, 0.97])
def test_equal_rows_part_over_shards(spark, tmp_path, of_none):
    text = "the same text in each of them " * 4
    n = int(4000 * of_none)
    rows = [(None, text)] * n + [(k, f"text number {k} " + "x" * (k % 90)) for k in range(4000 - n)]
    got = QUERIES["op6_sharding"](spark, _documents(tmp_path, rows)).collect()
    size, places = defaultdict(int), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert sorted((r["doc_id"] is None, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, len(t) + 16, zlib.crc32(t.encode())) for d, t in rows)
    assert max(size.values()) <= 1.05 * sum(size.values()) / 40 and min(size.values()) >= 0.9 * sum(size.values()) / 40
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_ordinary_rows_keep_the_slot_of_their_hash(spark, tmp_path):
    rows = sharding.sized(spark.read.parquet(_documents(tmp_path, [(k, f"t{k}") for k in range(3000)]) + "/documents.parquet"))
    assert sharding.parted(rows) is rows


# op 9


def _mix_rows():
    pick = random.Random(4)
    rows = [(None, "word " * pick.randint(0, 9), "a") for _ in range(1500)] + [(7, "some words here", "b")] * 700
    return rows + [(k, "word " * pick.randint(1, 40) + "#" * pick.randint(0, 5), pick.choice(["a", "b", None])) for k in range(1800)]


def test_mix_of_many_equal_ids_equals_its_sql(spark, tmp_path):
    folder = _documents(tmp_path, _mix_rows())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.sql("SELECT doc_id, size, source_size, target, taken FROM (" + ORACLE_SQL["op9_mixing"] + ")").fetchall(), key=repr)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for cell_rows in (100, 100_000):  # by distinct rows in parts, and by windows
        got = mixing.mixed(docs, cell_rows=cell_rows).selectExpr("doc_id", "size", "source_size", "round(target, 4) AS target", "taken")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


# op 7


@pytest.mark.parametrize("html, text", [('<p>Hello <span class="notice">world</span> again</p>', "Hello world again"), ('The <b class="share">market share</b> grew.', "The market share grew."), ('<p>new <em class="related">findings</em></p>', "new findings"), ('<p>a <span class="ad">b <span>c</span> d</span> e</p>', "a b c d e"), ("<p>a <span class=ad>b<p>c</span> d", "a b c d"), ('<p>a <a class="share" href="#">b</a>c</p>', "a bc")])
def test_inline_words_stay(html, text):
    assert html_extract.extract(f"<html><body><article>{html}</article></body></html>", None) == text
    assert html_extract.extract(html, None) == text


def test_inline_parts_that_stand_alike_in_all_pages_go():
    page = '<body><article><p>Text number {0} is about {0}. <span class="share">Share this</span></p><h2>And <b class="notice">more of {0}</b> follows.</h2></article></body>'
    pages = [page.format(f"subject{k} " * 3) for k in range(5)]
    wrapper = html_extract.infer([html_extract.stream(html_extract.parse(p)) for p in pages])
    known = html_extract.decide(wrapper, len(pages))
    assert html_extract.extract(pages[2], known) == "Text number subject2 subject2 subject2 is about subject2 subject2 subject2 . And more of subject2 subject2 subject2 follows.".replace("  ", " ")


def test_names_of_inline_elements_tell_no_template():
    plain, named = (html_extract.parse(f"<body><article><p>a <span{c}>b</span></p></article></body>") for c in ("", ' class="notice"'))
    assert html_extract.template_of(plain) == html_extract.template_of(named)


def test_alignment_is_longest_at_any_size():
    def length(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            before = row[:]
            for j, b in enumerate(y, 1):
                row[j] = before[j - 1] + 1 if a == b else max(before[j], row[j - 1])
        return row[-1]

    pick = random.Random(2)
    for n, m, letters in [(0, 3, "ab"), (1, 1, "a"), (5, 9, "abc"), (80, 70, "abcd"), (200, 90, "ab"), (400, 500, "abcdefgh")]:
        x, y = pick.choices(letters, k=n), pick.choices(letters, k=m)
        pairs = sorted(html_extract.longest_common(x, y))
        assert len(pairs) == length(x, y) and all(x[i] == y[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_given_pages_need_no_names(monkeypatch):
    t = pq.read_table("/root/testdata/sf0.01/pages.parquet").slice(0, 80)

    def texts():
        pages, known = [h or "" for h in t["html"].to_pylist()], {}
        for u, p in zip(t["url"].to_pylist(), pages):
            known.setdefault(((u or "").split("/")[2:3], html_extract.template_of(html_extract.parse(p))).__repr__(), []).append(p)
        rules = {k: html_extract.decide(html_extract.infer([html_extract.stream(html_extract.parse(p)) for p in v]), len(v)) for k, v in known.items()}
        return [html_extract.extract(p, rules[((u or "").split("/")[2:3], html_extract.template_of(html_extract.parse(p))).__repr__()]) for u, p in zip(t["url"].to_pylist(), pages)]

    with_names = texts()
    monkeypatch.setattr(html_extract, "HINTS", frozenset())
    assert texts() == with_names
