"""Clusters of whole-number vectors around moving centroids, all in exact integer arithmetic.

A vector finds its nearest centroid in a tournament. For a pair of centroids i < j the bisecting plane has
the integer normal 2 (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2; j is nearer exactly where the vector's
product with the normal is above the threshold, and a tie goes to i, the smaller number. So k - 1 sign tests
leave one centroid, and only its distance is computed. A round is one pass over the vectors; each task
gives one sum per centroid and component, which Spark adds up, so copies of a vector are no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialise

SCALE = 1024
#: rows compared with their planes at once
ROWS = 4096
#: numbers up to here are added and multiplied in 64 bits without overflow
SAFE = 1 << 62


def _longest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))


@dataclass(frozen=True)
class Planes:
    """The bisecting planes of every pair i < j, and what it takes to test and measure them in 64 bits."""

    centroids: list[list[int]]
    normals: np.ndarray
    thresholds: np.ndarray
    reach: int

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Planes:
        k, d = len(centroids), len(centroids[0])
        normals = np.zeros((k, k, d), object)
        thresholds = np.zeros((k, k), object)
        squares = [sum(x * x for x in c) for c in centroids]
        for i in range(k):
            for j in range(i + 1, k):
                normals[i, j] = [2 * (b - a) for a, b in zip(centroids[i], centroids[j])]
                thresholds[i, j] = squares[j] - squares[i]
        reach = max(abs(x) for c in centroids for x in c)
        if 4 * reach * reach * d < SAFE:
            normals, thresholds = normals.astype(np.int64), thresholds.astype(np.int64)
        return cls(centroids, normals, thresholds, reach)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of 64-bit vectors; distances are Python numbers where they may need more bits."""
        d = vectors.shape[1]
        longest = max(_longest(vectors), self.reach)
        if 8 * longest * longest * d >= SAFE:
            vectors, normals, thresholds = vectors.astype(object), self.normals.astype(object), self.thresholds.astype(object)
        else:
            normals, thresholds = self.normals, self.thresholds
        best = np.zeros(len(vectors), np.int64)
        for j in range(1, len(self.centroids)):
            side = (vectors * normals[best, j]).sum(axis=1) - thresholds[best, j]
            best = np.where((side > 0).astype(bool), j, best)
        away = vectors - np.array(self.centroids, vectors.dtype)[best]
        return best, (away * away).sum(axis=1)


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int) -> DataFrame:
    """(vec_id, v) of the vectors with ``dimensions`` components, none null or non-finite; v holds floor(1024 * component)."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) == dimensions) & fine)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, dimensions)


def _totals(vectors: DataFrame, planes: Planes, dimensions: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Of each centroid the vectors nearest to it: how many, their sum, and the sum of their squared distances."""
    k = len(planes.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, spreads = [0] * k, np.zeros((k, dimensions), object), [0] * k
        for _, block in _blocks(batches, dimensions):
            best, away = planes.nearest(block)
            # a sum of ROWS numbers of this size fits in 64 bits
            wide = block.astype(object) if _longest(block) >= SAFE // ROWS else block
            for c in np.unique(best).tolist():
                mine = best == c
                counts[c] += int(mine.sum())
                sums[c] += wide[mine].sum(axis=0).astype(object)
                spreads[c] += sum(away[mine].tolist())
        rows = [(c, m, str(x)) for c in range(k) if counts[c] for m, x in enumerate([counts[c], spreads[c], *sums[c]])]
        if rows:
            cs, ms, xs = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int32()), pa.array(ms, pa.int32()), pa.array(xs)], names=["cluster", "m", "x"])

    # k * (dimensions + 2) numbers reach the driver; a sum that has a part beyond 38 digits is none
    parts = vectors.select("vec_id", "v").mapInArrow(run, "cluster int, m int, x string")
    number = F.expr("try_cast(x AS decimal(38,0))")
    total = F.when(F.count(number) == F.count("x"), F.try_sum(number))
    summed = parts.groupBy("cluster", "m").agg(total.alias("x")).collect()
    counts, sums, spreads = [0] * k, [[0] * dimensions for _ in range(k)], [0] * k
    for c, m, x in ((r["cluster"], r["m"], None if r["x"] is None else int(r["x"])) for r in summed):
        if m == 0:
            counts[c] = x
        elif m == 1:
            spreads[c] = x
        else:
            sums[c][m - 2] = x
    return counts, sums, spreads


def _long(x: int | None) -> int | None:
    return x if x is not None and -1 << 63 <= x < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dimensions: int = 64,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors with ``dimensions`` components, none null or non-finite; each component becomes
    floor(1024 * component), at most what 64 bits hold. Centroids start as the ``k`` kept vectors with the least
    SHA-256 of ``seed:vec_id`` (fewer vectors, fewer centroids; a null id counts as an empty one; vectors of one
    id in the order of their components), and move ``rounds`` times to the floored mean of their vectors; one
    without vectors stays. Ties go to the smaller number. Equal rows are clustered each. A distance, or a sum of
    distances, beyond 64 bits is null. No kept vectors give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[vec_id]
    # written once: every round reads it
    kept = materialise(whole_vectors(vectors, vec_id, embedding, dimensions), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(hashed, "v").limit(k).select("v").collect()
    schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [list(r["v"]) for r in first]
    for _ in range(rounds):
        counts, sums, _ = _totals(kept, Planes.of(centroids), dimensions)
        centroids = [[x // n for x in total] if n else old for n, total, old in zip(counts, sums, centroids)]
    planes = Planes.of(centroids)
    _, _, spreads = _totals(kept, planes, dimensions)
    whole = None if None in spreads else sum(spreads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches, dimensions):
            best, away = planes.nearest(block)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array([_long(x) for x in away.tolist()], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)

    rows = kept.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.select("vec_id", "cluster", "distance", of_cluster([_long(x) for x in spreads], "long").alias("cluster_inertia"),
                       F.lit(_long(whole)).cast("long").alias("inertia"), of_cluster(shas, "string").alias("centroid_sha256"))
