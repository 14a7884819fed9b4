"""Winnowing fingerprints of whole texts (operator 9).

Every k-gram of code points has a hash of 40 bits; of each ``window`` consecutive hashes the
least is chosen, the rightmost of equal ones, and its position kept. Any run of
``window + k - 1`` code points that two texts share is then found in both fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import by_batch, documents, rolling_hashes, shuffle_partitions, window_minima

K, WINDOW = 16, 32


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """Hash of each k-gram; a text of fewer code points has one hash, an empty text none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return rolling_hashes(points, min(k, len(points))) if len(points) else points


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) and hashes (of 40 bits) of the chosen k-grams."""
    h = gram_hashes(text, k)
    if not len(h):
        return np.empty(0, np.int64), h
    at = window_minima(h, min(window, len(h)))
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, h[at] >> np.uint64(24)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes, positions of each text; null texts count as empty, empty ones have none."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [winnow(t or "", k, window) for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64())),
                pa.array([p for p, _ in found], pa.list_(pa.int64())),
            ],
            ["doc_id", "hashes", "positions"],
        )

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows in buckets of ascending (doc_id, hash of the text, text), null ids first, each bucket ending with a
    copy of the row that comes after it (after the last bucket: the first row of all).

    Texts move once. Buckets are cut at quantiles of the ids; an id that fills several quantiles is
    cut by the text's hash into as many, null likewise, and its equal rows are one row with a number of copies.
    Only one row per bucket is copied. Columns: bucket, tail (true for the copy), doc_id, h, text, copies.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    shares = F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000) if buckets > 1 else F.lit(None)
    n, known, found = base.agg(F.count("*"), F.count("doc_id"), shares).first()
    ids = Counter(found or [])
    cuts = sorted(ids)
    # parts of each id at a cut: the quantiles it fills; of null: half a bucket's share of all rows each
    missing = 1 + 2 * (n - known) * buckets // max(n, 1)
    parts = [missing, *(ids[c] for c in cuts)]
    rank = F.lit(0)
    if cuts:
        edges = F.array(*map(F.lit, cuts))
        # number of cuts that are not above the id, found by bisection in steps of powers of two
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        rank = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(edges, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at))
    rows = base.withColumn("_rank", F.when(F.col("doc_id").isNotNull(), rank).otherwise(-1))
    at_cut = F.col("_rank").between(1, len(cuts)) & (F.get(F.array(*map(F.lit, cuts)), F.col("_rank") - 1) == F.col("doc_id")) if cuts else F.lit(False)
    split = F.when(F.col("_rank") < 0, missing).when(at_cut, F.get(F.array(*map(F.lit, parts)), F.col("_rank"))).otherwise(0)
    # the hash as a number from 0, scaled to the parts; other ids of the rank come after them
    part = F.when(split > 0, F.shiftright((F.shiftright("h", 40) + (1 << 23)) * split, 24)).otherwise(F.lit(max(parts)))
    rows = rows.withColumn("_split", split).select(((F.col("_rank") + 1) * (max(parts) + 1) + part).cast("long").alias("bucket"), "_split", "doc_id", "h", "text")
    hot = rows.filter("_split > 1").groupBy("bucket", "doc_id", "h", "text").agg(F.count("*").alias("copies"))
    plain = rows.filter("_split <= 1").select("bucket", "doc_id", "h", "text", F.lit(1).cast("long").alias("copies"))
    whole = plain.unionByName(hot) if max(parts) > 1 else plain
    # at most two buckets for each cut and one for each part: a list of that bound
    heads = [tuple(r) for r in rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("k")).select("bucket", "k.doc_id", "k.h").orderBy("bucket").collect()]
    out = whole.select("bucket", F.lit(False).alias("tail"), "doc_id", "h", "text", "copies")
    if not heads:
        return out
    # the least row of each bucket goes to the end of the bucket before
    listed = spark.createDataFrame([(b, d, h, heads[i - 1][0]) for i, (b, d, h) in enumerate(heads)], "b long, d long, hh long, previous long")
    first = rows.join(F.broadcast(listed), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")))
    tails = first.groupBy("previous", "doc_id", "h").agg(F.min("text").alias("text"))
    return out.unionByName(tails.select(F.col("previous").alias("bucket"), F.lit(True).alias("tail"), "doc_id", "h", "text", F.lit(1).cast("long").alias("copies")))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the start of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def edit_trial(docs: DataFrame, k: int = K, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Texts follow each other by doc_id (null first), rows of one id by the hash of the text; the first
    follows the last. A fingerprint is the chosen hashes in ten hex digits each, in the order of ``positions``. Null texts are empty; an empty text has the fingerprint "" and likeness 1 to
    another empty one, 0 to any other. Repeated rows give repeated results. No rows: no rows.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = with_next(docs, buckets or 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "h", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions", "times"]

    def show(h):
        return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes().hex()

    def run(batches):
        last = None
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("bucket", "tail", "doc_id", "text", "copies")]
            for bucket, tail, doc_id, text, copies in zip(*columns):
                mine = winnow(text, k, window)
                if last and last[0] == bucket:
                    _, was, old, (at, h) = last
                    new = edited(old, text)
                    new_at, new_h = (at, h) if new == old else winnow(new, k, window)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((was, len(old), sha, show(h), show(new_h), likeness(h, new_h), likeness(h, mine[1]), at.tolist(), new_at.tolist(), 1))
                if copies > 1:  # each copy but the last is followed by itself
                    new = edited(text, text)
                    new_at, new_h = winnow(new, k, window)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((doc_id, len(text), sha, show(mine[1]), show(new_h), likeness(mine[1], new_h), 1.0, mine[0].tolist(), new_at.tolist(), copies - 1))
                last = None if tail else (bucket, doc_id, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()])],
                    names,
                )

    found = rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>, edited_positions array<long>, times long")
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "col")


def op9_winnowing(spark, sf_dir) -> DataFrame:
    return edit_trial(documents(spark, sf_dir))
