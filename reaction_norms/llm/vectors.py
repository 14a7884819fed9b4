"""Exact integer vectors inside tasks, and their sums over groups (for operators 11 and 13)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Long sums that tasks emit are parted into digits of this many bits.
DIGIT = 32
LONG_MAX = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    x = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component (scale: a power of two), a row for each vector of one length.

    Whole numbers as doubles where these add up exactly, Python integers where they might not.
    """
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if is_small(scaled):
        return scaled
    # a product beyond the doubles comes from a whole number
    whole = [int(s) if math.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel(), x.ravel())]
    return np.array(whole, object).reshape(x.shape)


def is_small(x: np.ndarray) -> bool:
    """Whether squared distances of such rows are sums that doubles hold exactly."""
    if x.dtype == object:
        return False
    most = math.isqrt((1 << 53) // (4 * max(1, x.shape[-1])))
    return not x.size or bool(np.abs(x).max() < most)


def points(rows: list[list[int]]) -> np.ndarray:
    """Integer points: doubles where they are exact, Python integers otherwise."""
    exact = np.array(rows, object)
    few = exact.size and max(abs(v) for v in exact.ravel()) < 1 << 53
    small = exact.astype(np.float64) if few else exact
    return small if is_small(small) else exact


def aligned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if both are small, both as Python integers otherwise."""
    if x.dtype != object and c.dtype != object:
        return x, c
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(c)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x (n, dim) to points c (k, dim), exact for aligned arrays."""
    if x.dtype == object:
        return np.array([((x - p) ** 2).sum(axis=1) for p in c], object).reshape(len(c), len(x)).T
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def as_long(values: np.ndarray) -> pa.Array:
    """Exact integers as longs; what is beyond them becomes the largest long."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([min(int(v), LONG_MAX) for v in values], pa.int64())


def long_sum(column: str) -> Column:
    """Exact sum of longs; what is beyond them becomes the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


class Sums:
    """Exact component sums and counts of groups, kept by one task."""

    def __init__(self, groups: int, dim: int):
        self.total = np.zeros((groups, dim), object)
        self.count = np.zeros(groups, np.int64)

    def add(self, x: np.ndarray, group: np.ndarray) -> None:
        self.count += np.bincount(group, minlength=len(self.count))
        for g in np.unique(group).tolist():
            # a batch of small numbers adds up exactly in doubles
            part = x[group == g].sum(axis=0)
            self.total[g] += part if x.dtype == object else part.astype(np.int64)

    def rows(self, offset: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(group, place, digit, value); the place after the last holds the count."""
        for g in np.flatnonzero(self.count).tolist():
            for place, value in enumerate([*self.total[g], int(self.count[g])]):
                digit = 0
                while not -(1 << 62) < value < 1 << 62:
                    yield g + offset, place, digit, value & ((1 << DIGIT) - 1)
                    value, digit = value >> DIGIT, digit + 1
                yield g + offset, place, digit, int(value)


def collected_sums(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, int, int]]]) -> dict[int, list[int]]:
    """By group: the sums by place, the count last, of what ``task`` yields of the batches of every task.

    The driver gets a row for each group, place and digit, whatever the number of vectors.
    """

    def run(batches):
        rows = list(task(batches))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["g", "place", "digit", "value"])

    summed = df.mapInArrow(run, "g long, place long, digit long, value long").groupBy("g", "place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, dict[int, int]] = {}
    for r in summed.collect():
        group = found.setdefault(r["g"], {})
        group[r["place"]] = group.get(r["place"], 0) + (int(r["value"]) << (DIGIT * r["digit"]))
    return {g: [places[i] for i in sorted(places)] for g, places in found.items()}


def moved(entries: list[list[int]], sums: dict[int, list[int]], offset: int = 0) -> list[list[int]]:
    """Each entry's componentwise floor(sum / count); entries without rows stay."""
    return [[s // sums[offset + g][-1] for s in sums[offset + g][:-1]] if offset + g in sums else old for g, old in enumerate(entries)]
