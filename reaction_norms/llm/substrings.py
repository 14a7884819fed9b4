"""Substring dedup by prefix-partitioned suffix trees over words (operator 5).

A suffix starts at each word that begins a window of ``window`` words. Suffixes that cannot
repeat are left out first: each window has an anchor, its least k-gram by hash, equal windows
have equal anchors, so windows whose anchor occurs once in the corpus are unique. The others
are dealt out by a prefix of variable length: the shortest of five lengths whose bin, by an
exact histogram, fits in memory; equal windows take equal prefixes. Each bin's subtree, down to the
depth of the window, is read off its suffix order: a window is three blocks of words, each a symbol (a 64-bit
digest), suffixes are sorted by their symbols, and the common prefixes of neighbours give the
internal nodes. Nodes as deep as the window are the repeats. Where the words before a node's suffixes
differ a maximal repeat begins, where the words after its windows differ one ends: between such
places lie the maximal repeats of the corpus, of any length. Whole runs of repeated windows are the spans that go.
Windows that alone would overfill a bin are counted by Spark beforehand; by that count there are at most four
for each shuffle partition, however large the corpus.

Texts with equal words are one class with a number of copies, so a hot group of copies moves
once. Class texts lie in buckets of a written table, and later joins move only what meets them.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.llm.common import DOCUMENT, by_batch, discard, documents, n_words, rolling_hashes, shared_path, shuffle_partitions, sorted_runs, stored, window_minima, written

WINDOW, GRAM, LEVELS, BLOCKS = 35, 6, 5, 3
JUDGED = LEVELS + 1
OPENS, CLOSES = 1, 2
#: Stands for the word before the first and after the last one; words are hashes of 30 bits there.
EDGE = 1 << 30


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of each window."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = rolling_hashes(h, min(gram, window))
    at = window_minima(grams, window - min(gram, window) + 1)
    return at, grams[at].view(np.int64)


def classify(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the class (c, tag: 96 bits of a digest of the words) of every row, with the text and the columns ``extra``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, tag, sha, n = [], [], [], []
        for text in batch["text"].to_pylist():
            words = _words(text)
            digest = hashlib.sha256(b" ".join(words))
            raw = digest.digest()
            c.append(int.from_bytes(raw[:8], "big", signed=True))
            tag.append(int.from_bytes(raw[8:12], "big") >> 1)
            sha.append(digest.hexdigest())
            n.append(len(words))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(c, pa.int64()), pa.array(tag, pa.int64()), pa.array(sha, pa.string()), pa.array(n, pa.int64()), batch["text"], *(batch[x] for x in extra)], ["doc_id", "c", "tag", "sha", "n_words", "text", *extra])

    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    return by_batch(docs, rows, "doc_id long, c long, tag long, sha string, n_words long, text string" + _schema(docs, extra))


def _schema(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", {x} {df.schema[x].dataType.simpleString()}" for x in names)


def class_table(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per class (c, tag, sha, n_words, copies, text, and the least of each column of ``extra``), written in buckets of (c, tag)."""
    spark = rows.sparkSession
    name = f"llm_classes_{uuid.uuid4().hex}"
    grouped = rows.groupBy("c", "tag").agg(F.min("sha").alias("sha"), F.min("n_words").alias("n_words"), F.count("*").alias("copies"), F.min("text").alias("text"), *[F.min(x).alias(x) for x in extra])
    grouped.write.bucketBy(shuffle_partitions(spark), "c", "tag").option("path", shared_path(spark, "classes")).option("compression", "zstd").saveAsTable(name)
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: its files lie under a path of their own
    return made


def repeated_anchors(classes: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """c, tag, anchors: for each class those of its anchors that occur twice or more in all classes (a written table)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, found, times = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, text in enumerate(batch["text"].to_pylist()):
            at, anchors = _anchors(_hashes(_words(text)), window, gram)
            # neighbouring windows share an anchor, windows that come again have one at another place
            own, n_places = np.unique(anchors[np.r_[True, at[1:] != at[:-1]]] if len(at) else anchors, return_counts=True)
            found.append(own)
            times.append(n_places)
            which.append(np.full(len(own), i))
        at = pa.array(np.concatenate([*which, np.empty(0, np.int64)]).astype(np.int64))
        return pa.RecordBatch.from_arrays([batch["c"].take(at), batch["tag"].take(at), pa.array(np.concatenate(found)), pa.array(np.concatenate(times))], ["c", "tag", "anchor", "n"])

    anchors, path = written(by_batch(classes.filter(F.col("n_words") >= window).select("c", "tag", "text"), rows, "c long, tag long, anchor long, n long"), "anchors")
    again = anchors.groupBy("anchor").agg(F.count("*").alias("places"), F.max("n").alias("n")).filter("places > 1 or n > 1").select("anchor")
    listed = stored(anchors.join(again, "anchor").groupBy("c", "tag").agg(F.collect_list("anchor").alias("anchors")), "listed")
    discard(classes.sparkSession, path)
    return listed


@dataclass
class Suffixes:
    """The suffixes of one text that may repeat: their starts, the hash of their prefix at each
    level, the digests of the blocks of their window, and the words on both sides of it."""

    starts: np.ndarray
    prefixes: list[np.ndarray]
    blocks: np.ndarray
    sides: np.ndarray

    @staticmethod
    def of(text: str, anchors: list[int], window: int, gram: int) -> Suffixes:
        h = _hashes(_words(text))
        starts = np.flatnonzero(np.isin(_anchors(h, window, gram)[1], np.array(anchors, np.int64)))
        prefixes = [rolling_hashes(h, -(-window * level // LEVELS))[starts] for level in range(1, LEVELS + 1)]
        edges = block_edges(window)
        blocks = np.stack([rolling_hashes(h, b - a)[starts + a] for a, b in zip(edges, edges[1:])])
        around = np.r_[EDGE, (h >> np.uint64(34)).astype(np.int64), EDGE]
        return Suffixes(starts, prefixes, blocks.view(np.int64), (around[starts] << 32) | around[starts + window + 1])


def block_edges(window: int) -> list[int]:
    """Where the blocks of a window begin, and its end."""
    return sorted({-(-window * i // BLOCKS) for i in range(BLOCKS + 1)})


def _differ(sides: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of rows: OPENS where the words before its windows differ, CLOSES where those after
    them do. A text's edge differs from everything, other edges included."""
    flags = np.zeros(len(starts), np.int64)
    for flag, word in ((OPENS, sides >> 32), (CLOSES, sides & 0xFFFFFFFF)):
        least, most = np.minimum.reduceat(word, starts), np.maximum.reduceat(word, starts)
        flags |= np.where((least != most) | (most == EDGE), flag, 0)
    return flags


def deep_nodes(blocks: list[np.ndarray], sides: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of one bin: (rows below its deep nodes, their flags).

    Suffixes are put in the order of their blocks; the common prefix of neighbours, in blocks,
    gives the internal nodes. Runs of neighbours that share all blocks are the leaves of one node as deep as the
    window. A single suffix is one too where its text has copies (``many``).
    """
    order = np.lexsort(blocks[::-1])
    shared, alike = np.zeros(len(order) - 1, np.int64), np.ones(len(order) - 1, bool)
    for x in blocks:
        alike &= x[order][1:] == x[order][:-1]
        shared += alike
    starts = np.flatnonzero(np.r_[True, shared < len(blocks)])
    sizes = np.diff(np.r_[starts, len(order)])
    node = np.repeat((sizes > 1) | (np.maximum.reduceat(many[order], starts) > 0), sizes)
    return order[node], np.repeat(_differ(sides[order], starts), sizes)[node]


def repeats(classes: DataFrame, window: int = WINDOW, gram: int = GRAM, ends: bool = True) -> DataFrame:
    """c, tag, places: 4 * start + flags of the windows whose words start elsewhere too.

    OPENS says that a maximal repeat (of ``window`` words or more) begins where the window does, CLOSES
    that one ends where it ends. Of classes with copies, all of whose windows repeat, only flagged ones are listed.
    Without ``ends`` there are no flags, and the words around the windows are not shuffled.
    """
    spark = classes.sparkSession
    parts = shuffle_partitions(spark)
    bins = max(4096, 16 * parts)
    n_blocks = len(block_edges(window)) - 1
    listed = repeated_anchors(classes, window, gram)
    texts = classes.select("c", "tag", "copies", "text").join(listed.hint("shuffle_hash"), ["c", "tag"])

    def each(batch):
        for c, tag, copies, text, anchors in zip(*(batch[name].to_pylist() for name in ("c", "tag", "copies", "text", "anchors"))):
            yield c, tag, copies, Suffixes.of(text, anchors, window, gram)

    def histogram(batches):
        sizes = np.zeros((LEVELS, bins), np.int64)
        for batch in batches:
            for *_, found in each(batch):
                for level, p in enumerate(found.prefixes):
                    sizes[level] += np.bincount((p % np.uint64(bins)).astype(np.int64), minlength=bins)
        level, place = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(place), pa.array(sizes[level, place])], ["level", "bin", "n"])

    sizes = stored(texts.mapInArrow(histogram, "level long, bin long, n long").groupBy("level", "bin").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.filter("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(512, total // (4 * parts))
    # bins over the size: at most LEVELS * total / most of them
    over = np.zeros((LEVELS, bins), bool)
    for r in sizes.filter(F.col("n") > most).select("level", "bin").collect():
        over[r["level"], r["bin"]] = True

    def dealt(prefixes):
        """Level and bin of each suffix; where no prefix fits, a bin of whole windows by another hash."""
        level, place = np.full(len(prefixes[0]), LEVELS), ((prefixes[-1] >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
        for i in reversed(range(LEVELS)):
            at = (prefixes[i] % np.uint64(bins)).astype(np.int64)
            fits = ~over[i][at]
            level[fits], place[fits] = i, at[fits]
        return level, place

    names = [f"b{i}" for i in range(n_blocks)]
    sides = ["before", "before_most", "after", "after_most"]
    # windows that alone would overfill a bin, with the flags of their node: at most total / most of them
    hot = {}
    if over[-1].any():

        def counted(batches):
            for batch in batches:
                found = [(f.blocks[:, big], f.sides[big]) for *_, f in each(batch) for big in [dealt(f.prefixes)[0] == LEVELS]]
                blocks = np.concatenate([b for b, _ in found], axis=1)
                order = np.lexsort(blocks[::-1])
                blocks, around = blocks[:, order], np.concatenate([x for _, x in found])[order]
                starts = np.flatnonzero(np.r_[[True] * (len(order) > 0), (blocks[:, 1:] != blocks[:, :-1]).any(0)])
                if not len(starts):
                    continue
                sums = [f.reduceat(word, starts) for word in (around >> 32, around & 0xFFFFFFFF) for f in (np.minimum, np.maximum)]
                n = np.diff(np.r_[starts, len(order)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, blocks[:, starts]), *map(pa.array, sums), pa.array(n)], [*names, *sides, "n"])

        schema = ", ".join(f"{x} long" for x in [*names, *sides, "n"])
        sums = [(F.max if x.endswith("_most") else F.min)(x).alias(x) for x in sides]
        again = texts.mapInArrow(counted, schema).groupBy(*names).agg(*sums, F.sum("n").alias("n")).filter(F.col("n") > most)
        for r in again.collect():
            opens = r["before"] != r["before_most"] or r["before_most"] == EDGE
            closes = r["after"] != r["after_most"] or r["after_most"] == EDGE
            hot[tuple(r[x] for x in names)] = opens * OPENS + closes * CLOSES
    hot_firsts = np.array(sorted({k[0] for k in hot}), np.int64)

    def suffixes(batches):
        for batch in batches:
            out = [np.empty((5 + n_blocks, 0), np.int64)]
            for c, tag, copies, found in each(batch):
                level, place = dealt(found.prefixes)
                around = found.sides.copy()
                for i in np.flatnonzero((level == LEVELS) & np.isin(found.blocks[0], hot_firsts)).tolist():
                    flags = hot.get(tuple(found.blocks[:, i].tolist()))
                    if flags is not None:  # already judged: dealt out evenly
                        level[i], place[i], around[i] = JUDGED, (c + int(found.starts[i])) % bins, flags
                at = found.starts + (tag << 32)
                out.append(np.stack([level, place, *found.blocks, around if ends else np.zeros_like(around), np.full(len(at), c), at if copies == 1 else ~at]))
            rows = np.concatenate(out, axis=1)
            for i in range(0, rows.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in rows], ["level", "bin", *names, "sides", "c", "at"])

    rows = texts.mapInArrow(suffixes, ", ".join(f"{x} long" for x in ["level", "bin", *names, "sides", "c", "at"]))
    rows = rows.repartition(parts, "level", "bin").sortWithinPartitions("level", "bin")

    def subtrees(batches):
        for level, _, *blocks, around, c, at in sorted_runs(batches, 2, least=1):
            many = at < 0
            at = np.where(many, ~at, at)
            found, flags = (np.arange(len(c)), around) if level[0] == JUDGED else deep_nodes(blocks, around, many)
            shown = ~many[found] | (flags > 0)
            found, flags = found[shown], flags[shown]
            yield pa.RecordBatch.from_arrays([pa.array(c[found]), pa.array(at[found] >> 32), pa.array(4 * (at[found] & 0xFFFFFFFF) + flags)], ["c", "tag", "place"])

    return rows.mapInArrow(subtrees, "c long, tag long, place long").groupBy("c", "tag").agg(F.collect_list("place").alias("places"))


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, ends: bool = True, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, cut): doc_id and class of each row, the classes, and of each class its kept text
    (words joined by one space; untouched where nothing goes), the spans removed, counts, the digest of what is
    kept, and the words at which maximal repeats begin (``opens``) and before which they end (``closes``)."""
    rows = stored(classify(docs, extra).drop("text"), "rows")
    classes = class_table(classify(docs, extra), extra)
    found = repeats(classes, window, gram, ends)
    both = classes.join(found.hint("shuffle_hash"), ["c", "tag"], "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, shas, kept_texts, spans, opens, closes = [], [], [], [], [], []
        for sha, n, copies, text, places in zip(*(batch[x].to_pylist() for x in ("sha", "n_words", "copies", "text", "places"))):
            places = np.array(places or [], np.int64)
            starts, first, last = places >> 2, places[(places & OPENS) > 0] >> 2, places[(places & CLOSES) > 0] >> 2
            if copies > 1 and n >= window:
                starts, first, last = np.arange(n - window + 1), np.r_[0, first], np.r_[last, n - window]
            opens.append(np.unique(first))
            closes.append(np.unique(last) + window)
            if not len(starts):
                removed.append(0), shas.append(sha), kept_texts.append(text), spans.append([])
                continue
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, starts, 1)
            np.add.at(step, starts + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = b" ".join([w for w, g in zip(_words(text), gone.tolist()) if not g])
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "surrogatepass"))
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch["c"], batch["tag"], batch["copies"], *(batch[x] for x in extra), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string()), pa.array(spans, kind), pa.array(opens, pa.list_(pa.int64())), pa.array(closes, pa.list_(pa.int64()))], ["c", "tag", "copies", *extra, "n_removed", "kept_sha256", "kept_text", "spans", "opens", "closes"])

    made = by_batch(both.select("c", "tag", "sha", "n_words", "copies", "text", "places", *extra), cut, "c long, tag long, copies long" + _schema(both, extra) + ", n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,length:long>>, opens array<long>, closes array<long>")
    return rows, classes, made


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans, opens, closes of every row.

    A word goes when a window of ``window`` words that holds it starts anywhere else as well, judged on
    the input. Null and empty texts have no words. Repeated rows are copies of each other, whatever
    their ids. No rows: no rows. Extra columns are not read.
    """
    rows, _, made = removed_spans(docs, window, gram)
    return rows.select("doc_id", "c", "tag", "n_words").join(made.drop("kept_text"), ["c", "tag"]).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "opens", "closes")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents with repeated passages cut out; texts that lose nothing stay as they are, null ones
    null, and no rows give no rows. Repeated rows are copies of each other. Extra columns are dropped."""
    docs = docs.select(*DOCUMENT)
    count = n_words(F.col("text").cast("string"))
    own = F.struct(*[x for x in DOCUMENT if x != "text"]).alias("own")
    # a class of one text carries the other columns, so that no text is joined again; of equal texts with a window nothing stays
    rows, classes, made = removed_spans(docs.filter(count >= window).select("doc_id", "text", own), window, gram, ends=False, extra=("own",))
    single = made.filter("copies = 1").select("own", F.col("kept_text").alias("text"), (F.col("n_removed") > 0).alias("cut"))
    copies = rows.join(classes.filter("copies > 1").select("c", "tag"), ["c", "tag"], "left_semi").select("own", F.lit("").alias("text"), F.lit(True).alias("cut"))
    n_chars = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("own.n_chars"))
    found = single.unionByName(copies).select("own.doc_id", "text", "own.lang", "own.source", n_chars.alias("n_chars"))
    return docs.filter(count < window).unionByName(found)


def op5_substrings(spark, sf_dir) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("spans", "opens", "closes")
