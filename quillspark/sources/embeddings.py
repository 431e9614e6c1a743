"""Embedding providers: anything with `model`, `dimension` and embed(list of texts) -> list of vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import STOP_WORDS
from quillspark.operators import incremental
from quillspark.operators.identity import Namespace

BATCH = 64


class Provider(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Deterministic: counts of tokens, their singulars and neighbouring pairs by hash bucket, of unit length. Equals ranking.hash_embeddings()."""

    kind, base_url = "local-hash", "http://localhost"

    def __init__(self, dimension: int = 256):
        self.dimension, self.model = dimension, f"hash-{dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            tokens = [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]
            features = tokens + [t[:-1] for t in tokens if len(t) > 3 and t[-1] == "s"] + ["_".join(p) for p in zip(tokens, tokens[1:])]
            counts = Counter(int(hashlib.sha256(f.encode()).hexdigest()[:8], 16) % self.dimension for f in features)
            norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
            out.append([counts[k] / norm for k in range(self.dimension)])
        return out


def namespace_of(provider, policy=None) -> Namespace:
    more = {} if policy is None else {"policy": policy}
    return Namespace(provider.kind, provider.model, provider.base_url, provider.dimension, **more)


def embedded(children: DataFrame, cache: DataFrame, provider) -> DataFrame:
    """Cache rows of all children: stored vectors where they hold, the others from the provider in batches of BATCH."""
    return incremental.embed_missing(children, cache, namespace_of(provider).fingerprint, provider.dimension, provider.embed, BATCH)


def query_vectors(queries: DataFrame, provider) -> DataFrame:
    """(query_id, vector); queries are never cached."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(texts.fillna("").tolist()))

    return queries.select("query_id", run("query").alias("vector"))
