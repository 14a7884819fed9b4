"""Codes of vector parts by k-means under adaptive distance bounds (operator 11).

For every part of a vector a written table keeps the ``b`` nearest entries of its codebook, in order, with a
lower bound for each rank (it bounds the ranks behind as well), the last of them the one outer bound of
all entries that are not listed. Entries move between rounds; a listed entry is nearer than its bound by no more
than it has moved since the table was written, the others by no more than the furthest move. The exact
distance to the first entry is computed, and the first rank whose bound lies above it says how many
entries are uncertain: these are compared in exact integers, all entries if the outer bound fails too.

Bounds that hold off too few parts (``STALE``) are written anew, with ``b`` adapted to the ranks that were
needed, and the table before is removed. A round reads the table in place and shuffles a row for each entry
component of a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import by_batch, discard, stored, table, written
from reaction_norms.llm.vectors import Sums, aligned, as_long, collected_sums, finite, integers, long_sum, moved, points, squared

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are written anew when more than this share of the parts had to be compared with all entries.
STALE = 1 / 8
#: b falls to the least rank that settled this share of the parts that bounds settled.
SETTLED = 15 / 16
#: Share that every bound gives way by, far above the errors of doubles and of bounds kept in four bytes.
GIVE = 1e-5


def ranked(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b nearest entries of each row, in order, and a lower bound for the ranks 1 to b and behind."""
    d = squared(*aligned(x, entries))
    order = np.argsort(d, axis=1, kind="stable")
    with np.errstate(over="ignore"):
        far = np.sqrt(np.take_along_axis(d, order[:, 1 : b + 1], axis=1).astype(np.float64)) * (1 - GIVE)
        low = np.full((len(x), b), np.inf, np.float32)
        low[:, : far.shape[1]] = far
    return order[:, :b].astype(np.uint8), low


def settled(x: np.ndarray, near: np.ndarray, low: np.ndarray, entries: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index), its exact squared distance, and the rank from which bounds held: b + 1 if none did."""
    x, entries = aligned(x, entries)
    b = near.shape[1]
    at = near[:, 0].astype(np.int64)
    best = ((x - entries[at]) ** 2).sum(axis=1)
    bound = low.astype(np.float64)
    bound[:, :-1] -= shift[near[:, 1:]]
    bound[:, -1] -= shift.max()
    bound = np.minimum.accumulate(bound[:, ::-1], axis=1)[:, ::-1]
    # a bound that is no number holds nothing off
    holds = np.sqrt(best.astype(np.float64))[:, None] * (1 + GIVE) < bound
    rank = np.where(holds.any(axis=1), holds.argmax(axis=1) + 1, b + 1)
    for z in range(2, b + 2):
        rows = np.flatnonzero(rank == z)
        if not len(rows):
            continue
        if z > b:
            d = squared(x[rows], entries)
            at[rows], best[rows] = d.argmin(axis=1), d.min(axis=1)
            continue
        listed = near[rows, :z].astype(np.int64)
        d = ((x[rows, None, :] - entries[listed]) ** 2).sum(axis=2)
        best[rows] = d.min(axis=1)
        at[rows] = np.where(d == best[rows, None], listed, len(entries)).min(axis=1)
    return at, best, rank


def _bounds(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    near = np.frombuffer(b"".join(batch["near"].to_pylist()), np.uint8).reshape(n, parts, -1)
    return near, np.frombuffer(b"".join(batch["low"].to_pylist()), "<f4").reshape(n, parts, -1)


def adapted(b: int, ranks: list[int], entries: int) -> int:
    """The least rank that settled ``SETTLED`` of the parts settled by bounds, at least an eighth of the entries, never more than b."""
    share = np.cumsum(ranks[: b + 1])
    need = int(np.searchsorted(share, SETTLED * share[-1])) if share[-1] else b
    return max(1, entries // 8, min(b, need))


def codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding"
) -> tuple[DataFrame, list[list[list[int]]], list[dict]]:
    """vec_id, label, code (an index for each part), error; the final codebooks; and a report of the rounds.

    Vectors that are null or hold null or non-finite components are left out, and so are those whose length is not
    that of the kept vector with the least vec_id, or cannot be cut into equal parts. Fewer vectors
    than entries: as many entries. Repeated rows count as often as they come; among rows that repeat
    a vec_id the lesser vector comes first, and a null vec_id comes last. Any finite component is
    computed exactly; an error beyond a long is given as the largest long. ``entries``: at most
    256. No vectors: no rows, no codebooks. Extra columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"entries: {entries}, not from 1 to 256")
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("x"))
    kept = kept.filter(finite(F.col("x")) & (F.size("x") > 0) & (F.size("x") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    least = kept.orderBy(*order).select(F.size("x").alias("n")).first()
    if least is None:
        return spark.createDataFrame([], "vec_id long, label long, code array<int>, error long"), [], []
    dim, width = least["n"], least["n"] // parts
    kept = kept.filter(F.size("x") == dim)
    first = integers(kept.orderBy(*order).limit(entries).select("x").toArrow()["x"].combine_chunks(), scale)
    books = [[[int(v) for v in row[p * width : (p + 1) * width]] for row in first] for p in range(parts)]
    k, b = len(first), min(max(1, entries // 4), max(1, len(first) - 1))
    kind, cuts = kept.schema["x"].dataType.simpleString(), [slice(p * width, (p + 1) * width) for p in range(parts)]
    source, path, report, stale = kept, None, [], True
    for r in range(rounds + 1):
        now = [points(book) for book in books]
        if stale:
            origin, old = now, path

            def listed(batch: pa.RecordBatch, origin=origin, b=b) -> pa.RecordBatch:
                x = integers(batch["x"], scale)
                found = [ranked(x[:, c], e, b) for c, e in zip(cuts, origin)]
                near, low = (np.stack(part, axis=1) for part in zip(*found))
                near, low = (pa.array([row.tobytes() for row in part], pa.binary()) for part in (near, low.astype("<f4")))
                return pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], near, low], ["vec_id", "label", "x", "near", "low"])

            source, path = written(by_batch(source.select("vec_id", "label", "x"), listed, f"vec_id long, label long, x {kind}, near binary, low binary"), "bounds")
            if old:
                discard(spark, old)
        shift = [np.sqrt(np.array([((p - q) ** 2).sum() for p, q in zip(*aligned(e, o))], np.float64)) * (1 + GIVE) for e, o in zip(now, origin)]
        if r == rounds:
            break

        def sums(batches, now=now, shift=shift, b=b):
            found, ranks = [Sums(k, width) for _ in cuts], np.zeros(b + 2, np.int64)
            for batch in batches:
                x, (near, low) = integers(batch["x"], scale), _bounds(batch, parts)
                for p, c in enumerate(cuts):
                    at, _, rank = settled(x[:, c], near[:, p], low[:, p], now[p], shift[p])
                    found[p].add(x[:, c], at)
                    ranks += np.bincount(rank, minlength=b + 2)
            for p, part in enumerate(found):
                yield from part.rows(p * k)
            yield from ((-1, z, 0, int(n)) for z, n in enumerate(ranks))

        got = collected_sums(source, sums)
        ranks = got.pop(-1)
        report.append({"round": r, "b": b, "written": stale, "ranks": ranks})
        books = [moved(book, got, p * k) for p, book in enumerate(books)]
        stale = r + 1 < rounds and ranks[-1] > STALE * sum(ranks)
        if stale:
            b = adapted(b, ranks, entries)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, (near, low) = integers(batch["x"], scale), _bounds(batch, parts)
        found = [settled(x[:, c], near[:, p], low[:, p], now[p], shift[p])[:2] for p, c in enumerate(cuts)]
        code = pa.array(np.stack([at for at, _ in found], axis=1).tolist(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], code, as_long(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    out = stored(by_batch(source, assign, "vec_id long, label long, code array<int>, error long"), "codes")
    discard(spark, path)
    return out, books, report


def op11_codes(spark, sf_dir) -> DataFrame:
    found, books, _ = codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    # labels may be as many as vectors: a plain join, which adaptive execution splits at a hot label
    by_label = found.groupBy("label").agg(long_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.concat_ws("", F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))))
    rows = found.join(by_label.hint("merge"), F.col("label").eqNullSafe(F.col("of")), "left")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
