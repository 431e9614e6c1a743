"""Scores of ops 2 and 10 over a whole table against restatements from the models' learned terms and weights, word by word."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspark.llm import quality_ranking, toxicity
from quillspark.llm.common import table
from quillspark.llm.queries import QUERIES

from .test_operators import edits

FOLDER = "/root/testdata/sf0.01"


def texts():
    t = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    return [(i, x or "") for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())]


def model_of(spark, label, module):
    return module.fit(toxicity.labelled(table(spark, FOLDER, "documents", "doc_id", "text"), table(spark, FOLDER, "labels", "doc_id", label), label))


def compare(spark, query, score):
    got = sorted((r["doc_id"], r["score"]) for r in QUERIES[query](spark, FOLDER).collect())
    want = sorted((i, score(t)) for i, t in texts())
    assert [i for i, _ in got] == [i for i, _ in want] and len(got) == 1000
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    assert len({round(s, 6) for _, s in want}) > 10  # they do differ


def logistic(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def test_toxicity_scores_of_a_table(spark):
    docs = toxicity.labelled(table(spark, FOLDER, "documents", "doc_id", "text"), table(spark, FOLDER, "labels", "doc_id", "toxic"), "toxic")
    model = model_of(spark, "toxic", toxicity)
    lexicon = toxicity.learn_lexicon(toxicity.Bags(docs), np.ones(len(docs), bool))
    assert lexicon and model.suspects
    seen = {}

    def distance(word):
        """The least edits to a term within its limit; 0 for words that begin with a stem."""
        whole = [d for t, stem in lexicon.items() for most in [0 if stem or len(t) < 5 else 1 if len(t) < 9 else 2] if abs(len(t) - len(word)) <= most and (d := edits(word, t)) <= most]
        return min(whole) if whole else 0 if any(stem and word.startswith(t) for t, stem in lexicon.items()) else None

    def looked(chunk):
        if chunk not in seen:
            word = chunk.strip(toxicity.MARKS)
            d = distance(word)
            if d is None and word and not word.isalpha():
                letters = [toxicity.LOOKALIKE.get(ord(c), c) for c in word]
                other = "".join(c for c in letters if c.isalpha())
                if other != word and len(other) >= 4 and 2 * sum(map(str.isalpha, word)) >= len(word) and distance(other) == 0:
                    d = 1
            if d and word in model.innocent:
                d = None
            weights = [model.suspects.get((word, False), 0.0), *(model.suspects.get((word[:n], True), 0.0) for n in range(4, 9) if n < len(word))]
            seen[chunk] = d, max(weights) if len(word) >= 3 else 0.0
        return seen[chunk]

    def quoted(chunks, k):
        core = chunks[k].strip(toxicity.MARKS)
        at = chunks[k].index(core) if core else len(chunks[k])
        before = " ".join([*chunks[max(0, k - 8) : k], chunks[k][:at]])
        after = " ".join([chunks[k][at + len(core) :], *chunks[k + 1 : k + 9]])
        last = lambda marks: max(before.rfind(m) for m in marks)
        return (last("«“„‘") > last("»”’") and any(m in after for m in "»”’“")) or (before.count('"') % 2 == 1 and '"' in after)

    def score(text):
        chunks = text.lower().split()
        found = [looked(c) for c in chunks]
        hits = [k for k, (d, _) in enumerate(found) if d is not None]
        heavy = [(k, w) for k, (_, w) in enumerate(found) if w]
        x = [1.0] + [0.0] * 7
        for k in hits:
            x[1 + 2 * (found[k][0] > 0) + quoted(chunks, k)] = 1.0
        x[5] = math.log1p(max((sum(k - 8 <= j < k for j in hits) for k in hits), default=0))
        x[6] = math.log1p(sum(w for _, w in heavy))
        x[7] = math.log1p(max((sum(w for j, w in heavy if k - 8 <= j <= k) for k, _ in heavy), default=0.0))
        return logistic(sum(a * b for a, b in zip(x, model.weights)))

    compare(spark, "op2_toxicity", score)


def test_quality_scores_of_a_table(spark):
    model = model_of(spark, "quality", quality_ranking)

    def score(text):
        raw, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x]
        chars, n = max(len(raw), 1), len(words)
        kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\t\n\v\f\r ", b"#*$%&|<>", b"!?", b".,;:"]
        counts = [sum(raw.count(bytes([c])) for c in kind) for kind in kinds]
        counts.append(sum(c >= 128 for c in raw))
        counts.append(len(raw) - sum(counts))  # all other bytes
        again = sum(words[k] == words[k - 1] for k in range(1, n))
        shares = [c / chars for c in counts] + [again / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), n / chars]
        x = [math.log1p(1000 * s) for s in shares] + [math.log1p(n), math.log1p(n) - math.log1p(len(set(words))), math.log1p(n / max(len(lines), 1))]
        z = [max(-4.0, min(4.0, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        strength = sum(a * w for a, w in zip(z + [a * a for a in z], model.weights))
        return logistic(strength - model.threshold)

    compare(spark, "op10_quality_ranking", score)
