"""Integer k-means with centroids filtered by n-simplex projection (operator 13).

A few pivots span a simplex. Every vector's distances to the pivots are computed once and kept as
the coordinates of an apex over that simplex: its foot, and its altitude last. The Euclidean
distance of two apexes is a lower bound of the distance of their vectors; with the sign of one
altitude turned it is an upper bound. A centroid whose lower bound is above the least upper
bound of a vector cannot be its nearest; those left are compared in exact integers.

The pivots are the centroids as they stand before the rounds of ``PROJECTED``, with those of the time before:
centroids that have moved little, or on in the same direction, lie near that simplex, where both bounds
nearly meet. Each round reads the written table of vectors and apexes in place and shuffles a row for each cluster and component of a task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import by_batch, discard, stored, table, written
from reaction_norms.llm.vectors import LONG_MAX, Sums, aligned, as_long, collected_sums, finite, integers, long_sum, moved, points, squared

K, ROUNDS, SCALE, DIM = 8, 10, 1024, 64
#: Rounds before which vectors are projected anew.
PROJECTED = (0, 1, 3, 6)
#: A pivot is used if its altitude over those before it is at least this share of its distance to the first,
#: so that errors of doubles stay far below SLACK, a share of the squared norms that bounds are widened by.
ALTITUDE, SLACK = 0.1, 1e-5


@dataclass
class Simplex:
    """Pivots with the coordinates of their simplex: row i has i coordinates, the last its altitude."""

    pivots: np.ndarray
    corner: np.ndarray

    @classmethod
    def of(cls, candidates: list[list[int]]) -> Simplex:
        """The simplex of those candidates that stand well above the ones before."""
        used, corner = [candidates[0]], np.zeros((1, 0))
        for row in candidates[1:]:
            apex = cls(points(used), corner).apexes(points([row]))[0]
            if np.isfinite(apex).all() and apex[-1] > ALTITUDE * np.sqrt((apex**2).sum()):
                used.append(row)
                corner = np.vstack([np.c_[corner, np.zeros(len(corner))], apex])
        return cls(points(used), corner)

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Apex coordinates of rows, from nothing but their distances to the pivots."""
        x, pivots = aligned(x, self.pivots)
        with np.errstate(over="ignore", invalid="ignore"):
            d = squared(x, pivots).astype(np.float64)
            out = np.zeros((len(x), len(pivots)))
            for j in range(1, len(pivots)):
                base = self.corner[j]
                inner = out[:, : j - 1] @ base[: j - 1]
                out[:, j - 1] = (d[:, 0] - d[:, j] + (base**2).sum() - 2 * inner) / (2 * base[j - 1])
            out[:, -1] = np.sqrt(np.maximum(d[:, 0] - (out[:, :-1] ** 2).sum(1), 0))
        return out


def bounds(apex: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances between vectors (n) and points (k), by their apexes."""
    with np.errstate(over="ignore", invalid="ignore"):
        foot = (apex[:, :-1] ** 2).sum(1)[:, None] + (other[:, :-1] ** 2).sum(1) - 2 * apex[:, :-1] @ other[:, :-1].T
        slack = SLACK * ((apex**2).sum(1)[:, None] + (other**2).sum(1))
        lower = foot + (apex[:, -1:] - other[:, -1]) ** 2 - slack
        return lower, foot + (apex[:, -1:] + other[:, -1]) ** 2 + slack


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its exact squared distance, and the number of centroids compared."""
    x, centroids = aligned(x, centroids)
    lower, upper = bounds(apex, other)
    # a bound that is no number discards nothing
    left = ~(lower > upper.min(1)[:, None])
    best, at = np.full(len(x), np.inf, x.dtype), np.zeros(len(x), np.int64)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(left[:, j])
        d = squared(x[rows], c[None, :])[:, 0]
        closer = d < best[rows]
        best[rows[closer]], at[rows[closer]] = d[closer], j
    return at, best, left.sum(1)


def _apexes(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch["apex"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, vector: str = "embedding", seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance, compared (centroids whose distance was computed); and the final centroids.

    Vectors that are null, of another length than ``dim``, or hold null or non-finite components are left out.
    Fewer than k vectors: as many clusters. Repeated rows count as often as they come; among rows that
    repeat a vec_id the lesser vector starts first, and a null vec_id starts last. Any finite
    component is computed exactly; a distance beyond a long is given as the largest long. No
    vectors: no rows, no centroids. Extra columns are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("x")).filter(finite(F.col("x")) & (F.size("x") == dim))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").toArrow()["x"].combine_chunks()
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, compared int"), []
    centroids = [[int(v) for v in row] for row in integers(first, scale)]
    kind = kept.schema["x"].dataType.simpleString()
    source, path, pivots = kept, None, []
    for r in range(rounds + 1):
        if r == 0 or (r in PROJECTED and r < rounds):
            pivots, old = [*centroids, *pivots[:k]], path
            simplex = Simplex.of(pivots)

            def project(batch: pa.RecordBatch, simplex=simplex) -> pa.RecordBatch:
                apex = simplex.apexes(integers(batch["x"], scale)).astype(np.float32)
                return pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], pa.array(list(apex), pa.list_(pa.float32()))], ["vec_id", "x", "apex"])

            source, path = written(by_batch(source.select("vec_id", "x"), project, f"vec_id long, x {kind}, apex array<float>"), "apexes")
            if old:
                discard(spark, old)
        now = points(centroids)
        other = simplex.apexes(now)
        if r == rounds:
            break

        def sums(batches, now=now, other=other):
            found = Sums(len(now), dim)
            for batch in batches:
                x = integers(batch["x"], scale)
                found.add(x, nearest(x, _apexes(batch), now, other)[0])
            yield from found.rows()

        centroids = moved(centroids, collected_sums(source, sums))

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, d, n = nearest(integers(batch["x"], scale), _apexes(batch), now, other)
        return pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(at, pa.int32()), as_long(d), pa.array(n, pa.int32())], ["vec_id", "cluster", "distance", "compared"])

    out = stored(by_batch(source, assign, "vec_id long, cluster int, distance long, compared int"), "clusters")
    discard(spark, path)
    return out, centroids


def op13_centroids(spark, sf_dir) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    # a row for each cluster, k at most
    inertia = {r["cluster"]: r["sum"] for r in found.groupBy("cluster").agg(long_sum("distance").alias("sum")).collect()}
    total = min(sum(inertia.values()), LONG_MAX)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(j, inertia.get(j, 0), total, digest) for j, digest in enumerate(digests)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
