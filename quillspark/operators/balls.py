"""Exact nearest vectors by cosine, from balls around pivots: whole balls are left out by the triangle inequality of angles.

build() puts each vector (id, vector) in the ball of its nearest pivot and notes the least and greatest angle of each ball's members to the pivot. A query at angle a
to a pivot is at least max(0, low - a, a - high) from any member, so no member's cosine is above the cosine of that. search() first scores each query with the balls of its
greatest bounds until they have k members, whose kth score is a threshold; then with all others whose bound reaches it. Results are those of ranking.dense_topk().

What is left out depends on the vectors: much where they lie in clusters narrower than the distance to the kth neighbour, nothing where directions are spread evenly in many
dimensions; Balls.share says how many of all products were made. Pivots are fitted to a bounded sample (SAMPLE vectors by digest of the id); that only
decides how tight balls are. Null vectors are in no ball, zero vectors are never found, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import ranking
from quillspark.sources import index_store

#: Pivots, vectors that they are fitted to, and rounds of that.
BALLS, SAMPLE, ROUNDS = 128, 16_384, 8
#: Radians that a bound gives way by, above all errors of arithmetic.
SLACK = 1e-6


def pivots(vectors: DataFrame, balls: int = BALLS, sample: int = SAMPLE):
    """Unit vectors, one a row: spherical means of a sample."""
    import numpy as np

    rows = vectors.where("vector IS NOT NULL").select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # SAMPLE
    if not rows:
        return np.zeros((0, 0))
    x = ranking.unit_rows(np.array([r["vector"] for r in rows], np.float64))
    means = x[np.unique(np.linspace(0, len(x) - 1, min(balls, len(x))).astype(int))]
    for _ in range(ROUNDS):
        near = (x @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        means = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), means)
    return means


def members(vectors: DataFrame, means) -> DataFrame:
    """(id, vector, angle, ball) of all vectors."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = ranking.unit_rows(ranking.matrix_of(b.column(1), means.shape[1]))
            dots = x @ means.T
            ball = dots.argmax(axis=1)
            angle = np.arccos(np.clip(dots[np.arange(len(x)), ball], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(angle), pa.array(ball.astype(np.int32))], names=["id", "vector", "angle", "ball"])

    rows = vectors.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).where("vector IS NOT NULL")
    return rows.mapInArrow(run, "id long, vector array<double>, angle double, ball int")


def build(spark: SparkSession, root: str, vectors: DataFrame, balls: int = BALLS, sample: int = SAMPLE) -> str:
    """Store vectors by ball, as an index generation. A ball is written by several tasks, so none has to hold a crowded one."""
    means = pivots(vectors, balls, sample)
    centres = spark.createDataFrame([(k, [float(v) for v in m]) for k, m in enumerate(means)], "ball int, pivot array<double>")
    ranges = lambda t: t["members"].groupBy("ball").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).join(F.broadcast(centres), "ball")
    return index_store.save(spark, root, {"members": members(vectors, means), "balls": ranges})


class Balls:
    """The stored balls of a root. share: the part of all products of queries and vectors that searches have made."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = index_store.load(spark, root)
        self.made = self.all = 0

    @property
    def share(self) -> float:
        return self.made / self.all if self.all else 0.0

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) of the best k per query; queries beyond ranking.MATRIX_BYTES go in blocks."""
        return ranking._in_blocks(queries, lambda rows: self._block(rows, k))

    def _block(self, rows: list, k: int) -> DataFrame:
        import numpy as np

        balls = self.tables["balls"].orderBy("ball").collect()  # BALLS
        ids = np.array([r["query_id"] for r in rows], np.int64)
        if not balls or not rows:
            return ranking.ranked(self._scored(ids, np.zeros((len(ids), 0)), np.zeros((len(ids), 0), bool), [], k), k)
        matrix, means = ranking.unit_rows(np.array([r["vector"] for r in rows], np.float64)), np.array([b["pivot"] for b in balls])
        if matrix.shape[1] != means.shape[1]:
            raise ValueError(f"vectors have {means.shape[1]} dimensions, queries {matrix.shape[1]}")
        low, high, n = (np.array([b[c] for b in balls]) for c in ("low", "high", "n"))
        angle = np.arccos(np.clip(matrix @ means.T, -1.0, 1.0))
        bound = np.cos(np.maximum(0.0, np.maximum(low - angle, angle - high) - SLACK))
        # the balls of the greatest bounds, until they have k members
        order = np.lexsort((angle, -bound), axis=1)
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        names = [b["ball"] for b in balls]
        seeds = ranking.ranked(self._scored(ids, matrix, first, names, k), k).drop("rank").checkpoint()
        kth = {r["query_id"]: r["kth"] for r in seeds.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).collect()}  # one a query
        least = np.array([kth.get(int(q), 0.0) for q in ids])
        rest = (bound >= least[:, None] - 1e-8) & ~first
        self.made, self.all = self.made + int(((first | rest) * n).sum()), self.all + int(len(ids) * n.sum())
        return ranking.ranked(seeds.unionByName(self._scored(ids, matrix, rest, names, k)), k)

    def _scored(self, ids, matrix, wanted, names, k: int) -> DataFrame:
        """(query_id, id, score): of each batch of a ball's members the best k of each query that wants the ball. Other balls' folders aren't read."""
        import numpy as np
        import pyarrow as pa

        some = np.flatnonzero(wanted.any(axis=0))
        askers = {int(names[j]): np.flatnonzero(wanted[:, j]) for j in some}

        def run(batches):
            for b in batches:
                at = b.column(0).to_numpy(zero_copy_only=False)
                for ball in np.unique(at):
                    mine = np.flatnonzero(at == ball)
                    part, asking = b.take(pa.array(mine)), askers[int(ball)]
                    x, key = ranking.unit_rows(ranking.matrix_of(part.column(2), matrix.shape[1])), part.column(1).to_numpy(zero_copy_only=False)
                    scores = matrix[asking] @ x.T
                    order = np.lexsort((np.broadcast_to(key, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
                    best = np.take_along_axis(scores, order, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asking], order.shape[1])), pa.array(key[order.ravel()]), pa.array(best.ravel())], names=["query_id", "id", "score"])

        rows = self.tables["members"].where(F.col("ball").isin(sorted(askers))).select("ball", "id", "vector")
        return rows.mapInArrow(run, "query_id long, id long, score double").where("score > 0")
