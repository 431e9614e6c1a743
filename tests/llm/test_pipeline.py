"""The pipeline's stages, each against a restatement over the stage's own input."""

import collections

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillspark.llm import toxicity
from quillspark.llm.common import written

from .conftest import is_held_out
from .test_queries import WORD, components, distances, key


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = written(f(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def test_stages_hand_on_documents(steps):
    first = steps["toxicity"][0]
    for name, (before, after) in steps.items():
        if name != "byte_bpe":
            assert after.columns == first.columns
    assert all(after.count() > 0 for _, after in steps.values())


def test_toxicity_stage(spark, steps, sf):
    before, after = steps["toxicity"]
    labels = pq.read_table(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    learn = [(bool(y), texts[i]) for i, y in sorted(zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist())) if i in texts and not is_held_out(i)]
    model = toxicity.fit(learn)
    assert {r["doc_id"] for r in after.collect()} == {i for i, t in texts.items() if model.score(t) < toxicity.REJECT}


def test_quality_stage(steps):
    from quillspark.llm import quality_rules as rules

    before, after = steps["quality_rules"]
    rows = [(r["doc_id"], r["lang"], r["text"] or "") for r in before.collect()]
    want = set()
    for (i, _, text), (c, w) in zip(rows, distances([r[1:] for r in rows])):
        words = WORD.findall(text)
        n = len(words)
        seen = collections.Counter(tuple(words[k : k + 8]) for k in range(n - 7))
        again = len({k + j for k in range(n - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)})
        strays = (len(text) >= rules.MIN_CHARS and c > rules.CHAR_LIMIT) or (n >= rules.MIN_WORDS and w > rules.WORD_LIMIT + rules.WORD_NOISE / n**0.5)
        if n >= 20 and 100 * again <= 30 * n and not strays:
            want.add(i)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _, _ in rows if i in want)


def test_near_copies_stage(steps):
    before, after = steps["near_copies"]
    want = {i for i, n, c in components([(r["doc_id"], r["text"], None) for r in before.collect()]) if c == i}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def mix(rows):
    """Copies of each row (doc_id, text, source): a restatement of keys, targets, epochs and prefix sums."""
    import hashlib
    import math

    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(total)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    copies = [0] * len(rows)
    for s in total:
        keyed = []
        for k, (i, t, own) in enumerate(rows):
            if own == s:
                u = (int(hashlib.md5(f"{'null' if i is None else i}:mix-1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                n, symbols = len(t or ""), sum(c in "#*$%&|<>" for c in t or "")
                keyed.append((-math.log(u) * (1 + 20 * symbols / max(n, 1)), k))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, at = target[s] - epochs * total[s], 0
        for _, k in sorted(keyed):
            copies[k] = epochs + ((at + size[k] / 2 <= rest) if size[k] else (at < rest))
            at += size[k]
    return copies


def test_mixing_stage(steps):
    before, after = steps["mixing"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    want = collections.Counter({r[0]: n for r, n in zip(rows, mix(rows)) if n})
    assert collections.Counter(r["doc_id"] for r in after.collect()) == want


def test_mixing_tells_texts_of_one_id_apart(spark, sf):
    pick = collections.deque(range(400))
    rows = [(k % 200, " ".join(f"w{k}" for _ in range(5 + 3 * (k % 7))) + " #" * (k % 5), "ab"[k % 3 == 0]) for k in pick]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, sf).collect())
    assert got == collections.Counter({r[:2]: n for r, n in zip(rows, mix(rows)) if n})


def test_tokenise_stage(steps):
    import hashlib

    import numpy as np
    import public_tokenizers
    import tiktoken

    from quillspark.llm.byte_bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = steps["byte_bpe"]
    want = []
    for r in before.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], r["lang"], r["source"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert collected(after) == sorted(want, key=key)


def test_odd_and_empty_tables(spark, odd, empty):
    for folder in (odd, empty):
        rows = corpus_pipeline.run(spark, folder).collect()
        assert folder == odd or rows == []
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, odd).columns == docs.columns


def test_copies_with_one_id(spark, odd):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "q r s")], "doc_id long, text string")
    assert collected(corpus_pipeline.drop_near_copies(spark, docs, odd)) == [(1, "a b c d e f g"), (None, "q r s")]




def test_copies_without_an_id(spark, odd):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(7, one), (None, one), (None, one + " more"), (None, two), (None, two), (None, "more " + two), (None, three), (9, three + " end"), (None, "x y"), (None, "x y"), (None, None), (None, None)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), odd).collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [7, 9]
    texts = [r["text"] for r in got if r["doc_id"] is None]
    assert len(texts) == 3 and None in texts and "x y" in texts and any(t in (two, "more " + two) for t in texts)
