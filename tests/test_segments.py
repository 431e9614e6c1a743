"""The log-structured index against an index made anew, its sizes, compaction, digests and writers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import tokenize
from quillspark.operators import chunking, ranking
from quillspark.plans.search import Search
from quillspark.sources import digests, index_store, segments

WORDS = ["refund", "mail", "order", "late", "parcel", "address", "days", "five", "reset", "link", "the", "how"]


def sections(spark, files):
    """files: name -> list of section texts"""
    rows = [(f"{f}#{k}", f, f"About {f[:1]}", [f"About {f[:1]}"], t) for f, texts in files.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, file string, heading string, heading_path array<string>, content string").withColumn("tokens", tokenize(F.concat_ws("\n", "heading_path", "content")))


def corpus(seed, names):
    pick = random.Random(seed)
    return {n: [" ".join(pick.choices(WORDS, k=pick.randint(0, 30))) for _ in range(pick.randint(1, 4))] for n in names}


def questions(spark):
    return spark.createDataFrame([(1, "How late are refunds of an order?"), (2, "reset link mail"), (3, "nothing known"), (4, "refund refund days")], "query_id long, query string")


def scores(df):
    return sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())


def same(spark, index, files):
    """Whether all scores over the live index are those of an index made anew."""
    new, q = sections(spark, files), questions(spark)
    lexical, vector = ranking.lexical_index(new), ranking.vector_index(ranking.child_tokens(chunking.children(new)))
    live = index.tables()
    assert scores(ranking.bm25_search(live["postings"], live["terms"], q)) == scores(ranking.bm25_search(lexical["postings"], lexical["terms"], q))
    want = scores(ranking.cosine_search(vector["postings"], vector["terms"], q))
    assert scores(ranking.cosine_search(live["child_postings"], live["child_terms"], q)) == want and want
    assert sorted(r["id"] for r in live["sections"].collect()) == sorted(f"{f}#{k}" for f, t in files.items() for k in range(len(t)))


def test_base_and_changes_equal_a_rebuild(spark, tmp_path):
    root, files = str(tmp_path / "index"), corpus(1, [f"f{k:02}.md" for k in range(12)])
    segments.update(spark, root, sections(spark, files))
    changed = corpus(2, ["f03.md", "f07.md", "new.md"])
    gone = ["f00.md", "f11.md", "never.md"]
    segments.update(spark, root, sections(spark, changed), gone=spark.createDataFrame([(g,) for g in gone], "path string"))
    files = {f: t for f, t in (files | changed).items() if f not in gone}
    index = segments.Segments(spark, root)
    same(spark, index, files)
    assert len(index.names) == 2 and index.stats().first()["n_files"] == len(files)
    segments.update(spark, root, sections(spark, {}), gone=spark.createDataFrame([("new.md",)], "path string"))  # a run of deletions alone
    del files["new.md"]
    same(spark, segments.Segments(spark, root), files)


def test_a_run_writes_what_it_changes(spark, tmp_path):
    def size():
        return {s: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "i" / s) for f in fs if f.endswith(".parquet") and "part" in f) for s in os.listdir(tmp_path / "i") if s.startswith("seg=")}

    root, pick = str(tmp_path / "i"), random.Random(3)
    many = {f"m{k:05}.md": [" ".join(f"w{pick.randint(0, 4000)}" for _ in range(60))] for k in range(4000)}
    segments.update(spark, root, sections(spark, many))
    base = sum(size().values())
    segments.update(spark, root, sections(spark, {"m00007.md": ["one changed file"]}))
    assert sum(size().values()) - base < base / 20
    assert segments.Segments(spark, root).stats().first()["n_sections"] == 4000


def test_tiers_are_compacted_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 2)
    root, files = str(tmp_path), {}
    for run in range(3):
        new = corpus(run, [f"f{k}.md" for k in (run, run + 1)])
        segments.update(spark, root, sections(spark, new))
        files |= new
    index = segments.Segments(spark, root)
    assert sorted(s["level"] for s in index.state["segments"]) == [0, 1]
    gone = segments.vacuum(spark, root, states=1)
    assert len([g for g in gone if g.startswith("seg=")]) == 2
    same(spark, segments.Segments(spark, root), files)


def test_tokens_are_looked_up_in_the_files_that_have_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FILE_ROWS", 20)
    root, pick = str(tmp_path), random.Random(5)
    files = {f"f{k:03}.md": [" ".join(f"{a}{b}{pick.randint(0, 9)}" for a, b in zip(pick.choices("abcdefgh", k=20), pick.choices("xyz", k=20)))] for k in range(60)}
    segments.update(spark, root, sections(spark, files))
    index = segments.Segments(spark, root)
    every, some = index.raw("lexical"), index.blocks("lexical", spark.createDataFrame([("ax1",), ("hz3",), ("none",)], "token string"))
    assert 0 < len(some.inputFiles()) <= 4 < len(every.inputFiles())
    want = every.where("token IN ('ax1', 'hz3', 'none')")
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    with segments.told(spark):
        plan = index.postings(spark.createDataFrame([("ax1",)], "token string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ax1" in plan


def test_search_over_segments(spark, tmp_path):
    root, files = str(tmp_path), corpus(8, [f"f{k}.md" for k in range(9)])
    segments.update(spark, root, sections(spark, files))
    new, q = sections(spark, files), questions(spark)
    rows = lambda s: sorted(map(str, s.compare(3).select("query_id", "stage", "pos", "id", F.round("score", 9)).collect()))
    assert rows(Search(segments.Segments(spark, root).search_tables(q), q)) == rows(Search.over(new, ranking.child_tokens(chunking.children(new)), q))


def _flip(path):
    with open(path, "r+b") as f:
        f.seek(os.path.getsize(path) // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 1]))
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):  # the local file system's own check
        os.remove(crc)


def test_a_changed_byte_is_refused(spark, tmp_path):
    root = str(tmp_path)
    segments.update(spark, root, sections(spark, corpus(4, ["a.md", "b.md"])))
    name = segments.state(spark, root)["segments"][0]["name"]
    folder = f"{root}/seg={name}/terms"
    _flip(next(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part")))
    index = segments.Segments(spark, root)
    assert index.live("sections").count() > 0  # what isn't read isn't checked
    with pytest.raises(ValueError, match="not as they were written"):
        index.terms()


def test_generations_refuse_changed_missing_and_added_files(spark, tmp_path):
    root = str(tmp_path)
    gen = index_store.save(spark, root, {"t": spark.range(50), "u": spark.range(5)})
    assert index_store.load(spark, root)["t"].count() == 50
    file = next(f"{root}/gen={gen}/t/{f}" for f in os.listdir(f"{root}/gen={gen}/t") if f.startswith("part"))
    _flip(file)
    os.utime(file, (1, 1))
    assert index_store.load(spark, root, names=["u"])["u"].count() == 5
    with pytest.raises(ValueError, match="not as they were written"):
        index_store.load(spark, root)
    os.rename(file, f"{root}/taken.parquet")
    with pytest.raises(ValueError, match="missing"):
        index_store.load(spark, root)
    other = index_store.save(spark, root, {"t": spark.range(7)})
    spark.range(3).write.mode("append").parquet(f"{root}/gen={other}/t")
    with pytest.raises(ValueError, match="doesn't know"):
        index_store.verify(spark, root, other)


def test_recorded_digests_can_not_be_changed_either(spark, tmp_path):
    base = str(tmp_path / "x")
    spark.range(9).write.parquet(f"{base}/t")
    want = digests.record(spark, base)
    digests.check(spark, base, want)
    with pytest.raises(ValueError, match="not those of its manifest"):
        digests.check(spark, base, "0" * 64)


def test_writers_and_settings(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    segments.update(spark, root, sections(spark, corpus(1, ["a.md"])), settings={"size": 1000})
    with pytest.raises(ValueError):
        segments.update(spark, root, sections(spark, corpus(2, ["b.md"])), settings={"size": 500})
    with pytest.raises(RuntimeError):
        segments.update(spark, root, sections(spark, corpus(2, ["b.md"])), settings={"size": 1000}, activate=lambda: False)
    before = segments.state(spark, root)
    monkeypatch.setattr(index_store, "_write_text", lambda *_: False)
    with pytest.raises(segments.Conflict):
        segments.update(spark, root, sections(spark, corpus(2, ["b.md"])), settings={"size": 1000})
    assert segments.state(spark, root) == before
    with pytest.raises(FileNotFoundError):
        segments.Segments(spark, str(tmp_path / "none"))


def test_digests_come_together_after_many_tasks_read_the_files(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(4000).repartition(6).write.parquet(path)
    plan = digests.gathered(digests.leaves(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("Exchange") < plan.index("Scan binaryFile")
    assert digests.gathered(digests.leaves(spark, path)).rdd.getNumPartitions() == 1
    digests.check(spark, path, digests.record(spark, path))


def test_bags_of_live_children_serve_batches_of_many_tokens(spark, tmp_path):
    """The same as by postings, without those of replaced sections; what is shuffled of a child is one row."""
    root = str(tmp_path)
    rows = lambda n, word: spark.createDataFrame([(f"s{k}", f"f{k}", "", [], f"{word} common w{k} " * (1 + k % 3)) for k in n], "id string, file string, heading string, heading_path array<string>, content string").withColumn("tokens", tokenize("content"))
    segments.update(spark, root, rows(range(12), "old"))
    segments.update(spark, root, rows((3, 4), "new"))
    index, q = segments.Segments(spark, root), spark.createDataFrame([(1, "old common w3"), (2, "new w5"), (3, "none")], "query_id long, query string")
    out = lambda df: [(r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]
    got = out(ranking.cosine_batch(index.bags(), index.child_terms(), index.norms(), q, 4))
    assert got and got == out(ranking.cosine_best(index.child_postings(), index.child_terms(), q, 4))
    assert index.bags().count() == 12 and index.bags().where("exists(terms, x -> x.token = 'new')").count() == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neither_texts_nor_tokens_are_shuffled_for_blocks(spark, tmp_path):
    """Sections and children stay where they are read; a table's blocks are shuffled once, packed."""
    root = str(tmp_path)
    segments.update(spark, root, sections(spark, corpus(6, [f"f{k}.md" for k in range(9)])))
    index = segments.Segments(spark, root)
    own, vectors = index.raw("sections"), index.raw("vectors")
    assert "Exchange" not in _plan(segments.child_vectors(chunking.children(own)))
    for df in (segments.lexical_blocks(own, ["mail"]), segments.child_blocks(vectors, ["mail"])):
        assert _plan(df).count("Exchange") == 1 and "packed" in _plan(df) and df.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("rows", [1, 7, 10**6])
def test_blocks_have_every_posting_once(spark, tmp_path, monkeypatch, rows):
    """Whatever the number of files, also where one token fills several and where texts have no tokens; ranges are those of the files."""
    monkeypatch.setattr(segments, "FILE_ROWS", rows)
    monkeypatch.setattr(segments, "GROUP", 4)
    monkeypatch.setattr(segments, "SLICE", 40)
    root, files = str(tmp_path), corpus(9, [f"f{k:02}.md" for k in range(15)]) | {"none.md": ["", "the how", "refund " * 300]}
    segments.update(spark, root, sections(spark, files))
    index, new = segments.Segments(spark, root), sections(spark, files)
    plain = lambda df: sorted(map(tuple, df.collect()))
    names = ["id", "token", "tf", "dl", "in_heading"]
    assert plain(index.postings().select(names)) == plain(ranking.lexical_postings(new).select(names))
    asked = spark.createDataFrame([("refund",), ("late",)], "token string")
    assert plain(index.postings(asked).select(names)) == plain(ranking.lexical_postings(new).where("token IN ('refund', 'late')").select(names))
    kids = ranking.child_counts(ranking.child_tokens(chunking.children(new)))
    assert plain(index._asked_counts(asked)) == plain(kids.where("token IN ('refund', 'late')"))
    ranges = index.raw("ranges").where("name = 'lexical'").orderBy("first", "last").collect()
    assert (len(ranges) > 2) == (rows < 10) and all(a["last"] <= b["first"] for a, b in zip(ranges, ranges[1:]))
    own = index.raw("lexical").select(F.col("_metadata.file_name").alias("file"), "token").groupBy("file").agg(F.min("token").alias("first"), F.max("token").alias("last"))
    assert plain(own) == sorted((r["file"], r["first"], r["last"]) for r in ranges)


def test_postings_of_a_section_lie_together(spark, tmp_path):
    """So a search adds up a section's scores where its group is read; without the postings of replaced sections."""
    root, files = str(tmp_path), corpus(10, [f"f{k:02}.md" for k in range(30)])
    segments.update(spark, root, sections(spark, files))
    changed = corpus(11, ["f03.md", "f17.md"])
    segments.update(spark, root, sections(spark, changed))
    index, q = segments.Segments(spark, root), questions(spark)
    rows = index.postings(ranking.query_tokens(q))
    runs = rows.select("id", F.spark_partition_id().alias("p")).rdd.mapPartitions(lambda it: [[k for k, _ in __import__("itertools").groupby(r["id"] for r in it)]]).collect()
    seen = [i for run in runs for i in run]
    assert len(seen) == len(set(seen)) > 20
    new = sections(spark, files | changed)
    out = lambda df: [(r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert out(ranking.bm25_best(rows, index.terms(), q, 3, whole=True)) == out(ranking.bm25_best(*ranking.lexical_index(new).values(), q, 3))


def test_a_run_leaves_nothing_behind_and_starts_no_worker_for_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    segments.update(spark, root, sections(spark, corpus(1, ["a.md", "b.md"])))
    segments.update(spark, root, sections(spark, corpus(2, ["b.md"])))
    assert not [x for x in os.listdir(root) if x.startswith("making-")]
    empty = segments._empty(spark, "dead_ids")
    assert empty.schema.simpleString() == "struct<segment:string,id:string>" and empty.count() == 0 and "ExistingRDD" not in _plan(empty)


def test_an_index_of_another_version_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    index_store._write_text(spark, f"{root}/log/{1:020d}", '{"version": 1, "settings": {}, "segments": []}')
    with pytest.raises(ValueError, match="version 1"):
        segments.Segments(spark, root)
