"""SimHash near-duplicates, compared through pivot distance tables (operator 6).

Every text has a 64-bit fingerprint: the majority of each bit over the hashes of its word
shingles. Equal fingerprints are one class. Classes meet where some blocks of their bits are
equal: of ``b`` blocks at most ``max_bits`` can differ, so the others agree, and every pair in
reach meets under at least one choice of blocks. Inside such a bucket a table of Hamming
distances to reference fingerprints (pivots) is precomputed; by the triangle inequality a pair
whose distances to any pivot differ by more than ``max_bits`` is discarded, and the survivors
are verified bit by bit. Buckets over the tile size are cut into tiles, and every pair of
tiles is a bucket of its own, so no task holds more than two tiles and no pair is lost. Each
bucket returns a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import DOCUMENT, by_batch, documents, shuffle_partitions, sorted_runs, stored
from reaction_norms.llm.components import components

SHINGLE, MAX_BITS, PIVOTS = 4, 4, 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of each word shingle of a text's lower-cased (A-Z) words; fewer words: of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Unsigned word of the bits that are set in over half the hashes; none: 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65280):
        # a byte for each bit, eight bytes in a word: 255 rows add up without a carry
        lanes = np.unpackbits(h[i : i + 65280].astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        ones += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; no words: 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), one row per row of docs."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.int64())], ["doc_id", "fp"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, fp long")


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of documents with fp, one row per row of docs."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "fp"])

    docs = docs.select(*DOCUMENT)
    return by_batch(docs, rows, docs.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", fp long")


def block_keys(n: int, max_bits: int = MAX_BITS) -> list[int]:
    """Bit masks of which two fingerprints in reach share one at least.

    The bits are cut into b blocks, and a mask takes all but ``max_bits`` of them. b is the least, from two more,
    for which n fingerprints leave about 32 in a bucket, so that buckets stay small at any size.
    """
    for b in range(max_bits + 2, max_bits + 6):
        cut = [64 * i // b for i in range(b + 1)]
        blocks = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(b)]
        masks = [sum(c) for c in combinations(blocks, b - max_bits)]
        if min(m.bit_count() for m in masks) >= log2(max(n, 2)) - 5:
            break
    return masks


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), 1) for i in range(count)], np.uint64)


def forest(fp: np.ndarray, tile: np.ndarray, max_bits: int = MAX_BITS, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (place, place) that span the linked groups of distinct fingerprints.

    Two tiles: only pairs across them count, the others are compared where a tile meets itself.
    """
    n = len(fp)
    reference = pivots() if table is None else table
    distance = np.bitwise_count(fp[:, None] ^ reference).astype(np.int16)
    order = np.argsort(distance[:, 0], kind="stable")
    fp_s, tile_s, dist = fp[order], tile[order], distance[order]
    two = tile_s.min() != tile_s.max()
    upto = np.searchsorted(dist[:, 0], dist[:, 0] + max_bits, side="right")
    label = np.arange(n)
    row = 0
    while row < n:
        # as many rows as give about a million pairs within reach of the first pivot
        stop = min(n, row + max(1, 1_000_000 // max(1, int(upto[row] - row))))
        counts = upto[row:stop] - np.arange(row, stop) - 1
        i = np.repeat(np.arange(row, stop), counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        if two:
            keep = tile_s[i] != tile_s[j]
            i, j = i[keep], j[keep]
        for p in range(1, dist.shape[1]):
            if not len(i):
                break
            keep = np.abs(dist[i, p] - dist[j, p]) <= max_bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp_s[i] ^ fp_s[j]) <= max_bits
        i, j = i[keep], j[keep]
        while len(i):
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        row = stop
    linked = np.flatnonzero(label != np.arange(n))
    return list(zip(order[linked].tolist(), order[label[linked]].tolist()))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all within reach."""
    spark = classes.sparkSession
    n = classes.count()
    parts = shuffle_partitions(spark)
    masks = block_keys(n, max_bits)
    tile = min(8192, max(512, n * len(masks) // (8 * parts)))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "key"))
    hot = stored(keyed.groupBy("mask", "key").count().filter(F.col("count") > tile).select("mask", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "tiles")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("one"), F.greatest(t, F.col("own")).alias("two")))
    rows = (
        keyed.join(hot, ["mask", "key"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .select("mask", "key", "own", "fp", F.explode(met).alias("met"))
        .select("mask", "key", "met.one", "met.two", "own", "fp")
        .repartition(parts, "mask", "key", "one", "two")
        .sortWithinPartitions("mask", "key", "one", "two")
    )

    def run(batches):
        for columns in sorted_runs(batches, 4):
            fp = columns[5].view(np.uint64)
            if found := forest(fp, columns[4], max_bits):
                a, b = (columns[5][list(x)] for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id that it reaches over links.

    Null and empty texts and texts without words have fingerprint 0 and are linked like any
    other. Repeated rows are copies. A null doc_id counts for no component_id unless all ids of
    the component are null (then null). No rows: no rows. Extra columns are not read.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, max_bits)).hint("merge")
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = stored(labelled.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of_class.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``near_duplicates``, with the columns of documents.

    It is the row of the least doc_id, among rows that repeat it that of the least text (null before
    others); a component without any id keeps its least text. Null and empty texts and texts without words
    have one fingerprint, so one of them stays. No rows: no rows. Extra columns are not read.
    """
    found = stored(fingerprinted(docs, shingle), "fingerprinted")
    classes = stored(found.select("fp").distinct(), "classes")
    roots = components(links(classes, max_bits)).hint("merge")
    # copies become one row where they lie, before they meet the root of their component
    row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *DOCUMENT)).alias("row")
    nodes = found.groupBy("fp").agg(row)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "row")
    return rooted.groupBy("root").agg(F.min("row").alias("row")).select(*(f"row.{c}" for c in DOCUMENT))
