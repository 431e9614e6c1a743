"""Quality classifier (op 10): Bradley-Terry pairwise ranking.

From labelled documents come preference pairs (a good one over a bad one); weights minimise the logistic loss on the difference of
their features, so a document's score is what a Bradley-Terry model calls its strength. The threshold is a quantile of the sample's
scores: as many lie below as the labels call bad. Scores are given as 1 / (1 + exp(threshold - strength)), so 0.5 is the threshold.

Labels are learned from a bounded sample of labelled documents (SAMPLE and SAMPLE_BYTES of op 2), never from held-out rows. Each document of
the more frequent kind is in EACH pairs, so no document is left out and the number of pairs follows the sample.
Defined results: null or empty text has all-zero shares and is scored like any other; a very long text is scored whole; a score of just
the threshold is 0.5 and accepted; repeated rows score alike; without labels of both kinds every score is 0.5; an empty table gives
no rows; extra columns aren't read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .toxicity import score_texts, trained

EACH, RIDGE, SEED, ACCEPT = 12, 0.3, 7, 0.5
#: Byte classes whose shares are features.
BYTES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "symbol": b"#*$%&|<>", "mark": b"!?", "comma": b".,;:", "other": range(128, 256)}
_classes = np.full(256, len(BYTES))
for _k, _v in enumerate(BYTES.values()):
    _classes[list(_v)] = _k


def features(text: str) -> np.ndarray:
    """Shares on a scale that tells small ones apart, over the whole text."""
    raw = text.encode()
    counts = np.bincount(_classes[np.frombuffer(raw, np.uint8)], minlength=len(BYTES) + 1)
    words = text.split()
    n, chars = len(words), max(len(raw), 1)
    again = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x]
    shares = [*(counts / chars), again / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), n / chars]
    x = np.log1p(1000 * np.array(shares))
    return np.append(x, [np.log1p(n), np.log1p(n) - np.log1p(distinct), np.log1p(n / max(len(lines), 1))])


class Ranker:
    """strength(text) = weights . (standardised features and their squares)."""

    def __init__(self, mean, scale, weights, threshold):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, z * z], axis=-1)

    def score(self, text: str) -> float:
        strength = self.design(features(text)) @ self.weights
        return float(1 / (1 + np.exp(np.clip(self.threshold - strength, -30, 30))))


def fit(docs: list[tuple[bool, str]]) -> Ranker:
    x = np.array([features(text) for _, text in docs]) if docs else np.zeros((1, len(features(""))))
    y = np.array([label for label, _ in docs], bool)
    model = Ranker(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(2 * x.shape[1]), 0.0)
    good, bad = np.flatnonzero(y), np.flatnonzero(~y)
    if not len(good) or not len(bad):
        return model
    # shuffled copies of both kinds side by side: every document has its share of pairs, each with others
    pick, n = np.random.default_rng(SEED), EACH * max(len(good), len(bad))
    a, b = (np.concatenate([pick.permutation(x) for _ in range(-(-n // len(x)))])[:n] for x in (good, bad))
    z = model.design(x)
    d, w = z[a] - z[b], model.weights
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # how wrong each pair still is
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE / len(docs) * np.eye(len(w)), d.T @ p / len(d) - RIDGE / len(docs) * w)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-5:
            break
    strengths = np.sort(z @ w)
    cut = len(bad)
    return Ranker(model.mean, model.scale, w, float((strengths[cut - 1] + strengths[min(cut, len(strengths) - 1)]) / 2))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), "quality", fit)
    return score_texts(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
