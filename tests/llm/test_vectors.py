"""Vector codes and centroid clustering against brute force in Python integers."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reaction_norms.llm import centroids, codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def whole(v, scale):
    return [math.floor(f32(x) * scale) if abs(x) < 1e300 else int(x) * scale for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(rows, start, rounds):
    """(nearest, squared distance) of each row, and the entries, after the rounds."""
    entries = [list(e) for e in start]
    for r in range(rounds + 1):
        near = [min((distance(v, e), j) for j, e in enumerate(entries)) for v in rows]
        if r == rounds:
            return near, entries
        for j in range(len(entries)):
            if mine := [v for v, (_, k) in zip(rows, near) if k == j]:
                entries[j] = [sum(c) // len(mine) for c in zip(*mine)]


def brute_clusters(rows, dim=64):
    kept = [(i, whole(v, 1024)) for i, v, _ in rows if usable(v) and len(v) == dim]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    near, entries = lloyd([v for _, v in kept], [v for _, v in sorted(kept, key=key)[:8]], 10)
    return sorted(((i, j, min(d, vectors.LONG_MAX)) for (i, _), (d, j) in zip(kept, near)), key=str), entries


def brute_codes(rows):
    kept = [(i, whole(v, 4096), label) for i, v, label in rows if usable(v) and v and len(v) % 8 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 8
    found = [lloyd([v[p * w : p * w + w] for _, v, _ in kept], [v[p * w : p * w + w] for _, v, _ in kept[:16]], 6) for p in range(8)]
    out = [(i, [found[p][0][n][1] for p in range(8)], min(sum(found[p][0][n][0] for p in range(8)), vectors.LONG_MAX)) for n, (i, _, _) in enumerate(kept)]
    return sorted(out, key=str), [entries for _, entries in found]


def odd_rows():
    """Bad vectors, repeated rows and ids, ties, a hot label, other lengths, very large components."""
    rng = np.random.default_rng(7)
    near = [[f32(x) for x in rng.normal(c, 0.2, 64)] for c in rng.integers(-2, 3, 150).tolist()]
    rows = [(i, v, None if i % 3 == 0 else i % 4) for i, v in enumerate(near)]
    rows += [(3, near[3], 0), (3, near[3], 0), (3, near[4], 0), (None, near[5], None), (None, near[6], 1)]
    rows += [(200, [0.25] * 64, 2), (201, [-0.25] * 64, 2), (202, [0.0] * 64, 2), (203, [-1e-9] * 64, 2)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [None, *near[0][1:]], 1), (-2, [float("nan"), *near[0][1:]], 1), (-1, [float("inf"), *near[0][1:]], 1)]
    return rows + [(300, near[0][:63], 1), (301, near[0][:8], 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "near", "low", "code", "cluster", "apex", "distance", "g", "of")}).repartition(5)


LARGE = [(400, [3e38] * 64, 1), (401, [-3e38, 3e38] * 32, 1), (402, [1e20, *[0.5] * 63], 1), (403, [1e-40] * 64, 1)]


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows() + LARGE, odd_rows()[:5]], ids=["odd", "large", "few"])
def test_clusters_are_those_of_brute_force(spark, rows):
    found, entries = centroids.clusters(frame(spark, rows))
    want, last = brute_clusters(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == want
    assert entries == last


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows() + LARGE, odd_rows()[:5], odd_rows()[:1]], ids=["odd", "large", "few", "one"])
def test_codes_are_those_of_brute_force(spark, rows):
    found, books, _ = codes.codes(frame(spark, rows))
    want, last = brute_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error) for r in found.collect()), key=str) == want
    assert books == last


def test_no_usable_vectors(spark):
    empty = frame(spark, [(1, None, 1), (2, [float("nan")] * 64, None)])
    assert centroids.clusters(empty)[0].count() == 0 and codes.codes(empty)[0].count() == 0
    assert centroids.clusters(empty.limit(0))[1] == [] and codes.codes(empty.limit(0))[1] == []


def test_queries_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = brute_codes(rows)
    label = {i: x for i, _, x in rows}
    got = codes.op11_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, "".join(f"{c:02x}" for c in code), e) for i, code, e in want)
    for r in got:
        assert r.label_error == sum(e for i, _, e in want if label[i] == label[r.vec_id])
    text = ",".join(str(v) for book in books for entry in book for v in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}

    want, entries = brute_clusters(rows)
    got = centroids.op13_centroids(spark, sf).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, entries[r.cluster])).encode()).hexdigest()


def test_apex_bounds_hold_and_discard(spark, sf):
    x = np.floor(1024 * np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()]))
    simplex = centroids.Simplex.of([[int(v) for v in row] for row in x[:8]])
    points = vectors.points([[int(v) for v in row] for row in (x[:8] + x[8:16]) // 2])
    lower, upper = centroids.bounds(simplex.apexes(x), simplex.apexes(points))
    exact = ((x[:, None, :] - points) ** 2).sum(-1)
    assert (lower <= exact).all() and (exact <= upper).all() and len(simplex.pivots) == 8
    # before the first round the centroids are the pivots: one is left to compare
    assert (centroids.nearest(x, simplex.apexes(x), simplex.pivots, simplex.apexes(simplex.pivots))[2] <= 2).all()


def test_repeated_and_aligned_pivots_are_left_out():
    rows = [[0] * 4, [0] * 4, [8, 0, 0, 0], [16, 0, 0, 0], [0, 5, 0, 0]]
    assert centroids.Simplex.of(rows).pivots.tolist() == [[0] * 4, [8, 0, 0, 0], [0, 5, 0, 0]]


def test_bounds_are_kept_ordered_and_adapted(spark, sf):
    _, _, report = codes.codes(spark.read.parquet(f"{sf}/embeddings.parquet"))
    n = 8 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert [r["round"] for r in report] == list(range(6)) and all(sum(r["ranks"]) == n for r in report)
    # the first round after writing settles nearly all parts at rank 1, and b never grows
    assert report[0]["ranks"][1] > 0.9 * n and [r["b"] for r in report] == sorted((r["b"] for r in report), reverse=True)
    assert codes.adapted(4, [0, 90, 8, 2, 0, 50], 16) == 2 and codes.adapted(4, [0, 10, 10, 10, 10, 0], 16) == 4
    x, entries = np.array([[0.0], [9.0]]), np.array([[1.0], [2.0], [8.0], [20.0]])
    near, low = codes.ranked(x, entries, 2)
    assert near.tolist() == [[0, 1], [2, 1]] and (np.diff(low, axis=1) >= 0).all()
    # the unlisted entry comes next to the first row: only the outer bound can tell
    moved = np.array([[7.0], [6.0], [8.0], [5.0]])
    at, d, rank = codes.settled(x, near, low, moved, np.abs(moved - entries)[:, 0])
    assert at.tolist() == [3, 2] and d.tolist() == [25, 1] and rank[0] == 3


def test_sums_beyond_a_long_are_exact(spark):
    x = np.array([[1 << 70, -(1 << 90)], [5, -7]], object)
    found = vectors.Sums(2, 2)
    found.add(x, np.array([1, 1]))
    df = spark.range(1).coalesce(1)
    assert vectors.collected_sums(df, lambda batches: list(found.rows())) == {1: [(1 << 70) + 5, -(1 << 90) - 7, 2]}
