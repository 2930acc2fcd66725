"""Vectors in clusters, for an exact search that reads few of them.

Centers are chosen from a bounded sample; every vector goes to its nearest one, into files of its own cluster, with the
cluster's radius (the greatest distance from the center). For a question q no vector of a cluster has a dot product above
q . center + |q| radius. The k best of the clusters with the highest bounds give a threshold, and only clusters whose bound
reaches it are read. The result is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import retrieval

#: Vectors of a cluster that centers aim at, rows of the sample, and the most centers (rows of numbers on the driver).
CLUSTER_ROWS, SAMPLE_ROWS, MOST_CENTERS, ROUNDS, SEED = 1_000, 50_000, 4_096, 8, 20260101
#: A dot product is rounded to nine decimals.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Clusters:
    """`vectors` (written, partitioned by cluster): key, vector, cluster; centers, and each cluster's radius (-1: it has none)."""

    vectors: DataFrame
    centers: np.ndarray
    radius: np.ndarray

    def bounds(self, questions: np.ndarray) -> np.ndarray:
        """The greatest dot product that each question can have with a vector of each cluster."""
        out = questions @ self.centers.T + np.linalg.norm(questions, axis=1)[:, None] * self.radius[None, :] + ROUNDING
        out[:, self.radius < 0] = -np.inf
        return out


def choose_centers(vectors: DataFrame, n: int) -> np.ndarray:
    """Centers of a bounded sample by some rounds of averaging."""
    share = F.xxhash64("key", F.lit(SEED))
    # the least hashes: SAMPLE_ROWS rows at most
    rows = np.array([r["vector"] for r in vectors.orderBy(share).limit(SAMPLE_ROWS).select("vector").collect()], float)
    random = np.random.default_rng(SEED)
    centers = rows[random.choice(len(rows), min(n, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmin((centers * centers).sum(1)[None, :] - 2 * rows @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def build(vectors: DataFrame) -> Clusters:
    """`vectors`: key, vector (all of one length)."""
    vectors = vectors.select("key", F.col("vector").cast("array<double>").alias("vector"))
    kind = vectors.schema["key"].dataType.simpleString()
    total = vectors.count()
    if not total:
        return Clusters(vectors.withColumn("cluster", F.lit(0)), np.zeros((0, 0)), np.zeros(0))
    centers = choose_centers(vectors, min(MOST_CENTERS, max(1, -(-total // CLUSTER_ROWS))))
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.argmin((centers * centers).sum(1)[None, :] - 2 * rows @ centers.T, axis=1)
            far = np.linalg.norm(rows - centers[near], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array(near.astype(np.int32)), pa.array(far)], ["key", "vector", "cluster", "far"])

    dealt = vectors.mapInArrow(run, f"key {kind}, vector array<double>, cluster int, far double")
    # a cluster that holds much of the table is several files; a batch of one cluster is read for its questions
    kept = tables.written(dealt.repartition("cluster", F.pmod(F.xxhash64("key"), F.lit(16))), "cluster")
    radius = np.full(len(centers), -1.0)
    for r in kept.groupBy("cluster").agg(F.max("far").alias("far")).collect():  # a number for each center
        radius[r["cluster"]] = r["far"]
    return Clusters(kept.drop("far"), centers, radius)


def nearest(clusters: Clusters, questions: DataFrame, k: int = retrieval.CANDIDATES) -> tuple[DataFrame, float]:
    """question_id, key, score and place as `retrieval.nearest`; the share of the (question, cluster) pairs that were read.
    `questions`: question_id, question_vector, as many as go to every task."""
    asked = questions.collect()
    matrix = np.array([r["question_vector"] for r in asked], float)
    n = len(clusters.centers)
    if not len(asked) or not n:
        return retrieval.nearest(clusters.vectors.limit(0), questions, k), 0.0
    bounds = clusters.bounds(matrix)
    # the best clusters of each question that hold k vectors in all likelihood
    few = max(1, -(-2 * k // CLUSTER_ROWS))
    first = np.argsort(-bounds, axis=1, kind="stable")[:, : min(few, n)]
    floor = np.full(len(asked), -np.inf)
    best = _compared(clusters, matrix, first, k)
    order = Window.partitionBy("question").orderBy(F.desc("score"), "key")
    for r in best.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).collect():
        floor[r["question"]] = r["score"]
    within = bounds >= floor[:, None] - 2 * ROUNDING
    wanted = [np.flatnonzero(w) for w in within]
    found = _compared(clusters, matrix, wanted, k)
    ranked = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    kind = questions.schema["question_id"].dataType.simpleString()
    named = questions.sparkSession.createDataFrame([(i, r["question_id"]) for i, r in enumerate(asked)], f"question int, question_id {kind}")
    rows = ranked.join(F.broadcast(named), "question").select("question_id", "key", "score", (F.col("n") - 1).alias("place"))
    return rows, float(within.sum()) / within.size


def _compared(clusters: Clusters, matrix: np.ndarray, wanted: list[np.ndarray] | np.ndarray, k: int) -> DataFrame:
    """question (its number), key and score: the k best of each task among the wanted clusters of each question."""
    by_cluster: dict[int, list[int]] = {}
    for q, own in enumerate(wanted):
        for c in own:
            by_cluster.setdefault(int(c), []).append(q)
    shared = clusters.vectors.sparkSession.sparkContext.broadcast((matrix, by_cluster))
    kind = clusters.vectors.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, by_cluster = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            near = batch.column("cluster").to_numpy()
            for c in np.unique(near).tolist():
                mine, take = by_cluster.get(c, []), pa.array(np.flatnonzero(near == c))
                rows = batch.column("vector").take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(take), -1)
                keys = batch.column("key").take(take).to_numpy(zero_copy_only=False)
                for part in (mine[i : i + retrieval.QUESTIONS_AT_ONCE] for i in range(0, len(mine), retrieval.QUESTIONS_AT_ONCE)):
                    scores = np.round(rows @ matrix[part].T, 9)
                    for column, q in enumerate(part):
                        own, names = scores[:, column], keys
                        if q in held:
                            own, names = np.concatenate((held[q][0], own)), np.concatenate((held[q][1], names))
                        order = retrieval._best(own, names, k)
                        held[q] = (own[order], names[order])
        for q, (scores, keys) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), q, np.int32)), pa.array(keys), pa.array(scores)], ["question", "key", "score"])

    tables.small_batches(clusters.vectors.sparkSession)
    # a condition on the partition column: other clusters' files aren't opened
    some = clusters.vectors.filter(F.col("cluster").isin(sorted(by_cluster)))
    return some.select("key", "vector", "cluster").mapInArrow(run, f"question int, key {kind}, score double")
