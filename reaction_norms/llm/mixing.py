"""Mixing sources to target weights in fixed-length blocks (operator 8).

The words of each source, its documents in pseudorandom order, form one stream, cut into
blocks; a source whose target is few blocks has shorter ones. Each output shard draws its source counts multinomially by target weight; draws beyond
a source's target give way to sources that lack some, so totals meet the targets. The slots
of a source run over its blocks in a pseudorandom permutation, once through before any block
comes again, and blocks are joined by index. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reaction_norms.llm.common import DOCUMENT, SPACE_RUN, SPACE, before, bucket_bits, documents, hash_bucket, n_words, stored

BLOCK, SHARD, CELL, ROUNDS = 128, 1024, 256, 16
WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2, 7


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source_id, source, source_size, target from (source, source_size).

    Sources in ascending order of what they can give for their weight are full as long as an
    equal share by weight of what is left would exceed that; the others share the rest. One
    row per source goes through the windows.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = totals.withColumn("source_id", place.cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("w", weight).withColumn("full", F.col("source_size") * most)
    up = Window.orderBy(F.col("full") / F.col("w"), "source_id")
    all_rows = Window.partitionBy()
    rows = rows.withColumn("left", share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("level", F.col("left") / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("open", F.col("full") > F.col("level") * F.col("w"))
    rows = rows.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), F.col("level") * F.col("w")))
    return rows.select("source_id", "source", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1: in each round an index and its mirror image about a
    keyed point swap or stay, by a hash of the greater of the two."""

    def step(x: Column, r: Column) -> Column:
        twin = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, twin), key, r, F.lit(1)), F.lit(2)) == 1, twin).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)


def _by_interval(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Join each point to the one interval that holds it, by cells of equal width."""
    cells = intervals.filter(F.col(high) > F.col(low)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor((F.col(high) - 1) / CELL))))
    joined = points.withColumn("cell", F.floor(F.col(at) / CELL)).join(cells, "cell")
    return joined.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("cell")


def block_of(size: Column, target: Column, block: int) -> tuple[Column, Column]:
    """Words in a block of a source, and how many blocks to take. A source taken whole gives each block
    as often as may be; any other has 16 blocks or more in what it gives, as far as words go."""
    whole = target >= MOST * size
    words = F.when(whole, block).otherwise(F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.least(size, target) / 16)))).cast("long")
    all_blocks = MOST * F.ceil(size / words)
    return words, F.when(whole, all_blocks).otherwise(F.least(F.round(target / words).cast("long"), all_blocks))


def slots(sources: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, slot, source_id, turn, block: which block of which source fills each slot."""
    spark = sources.sparkSession
    w = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    words, want = block_of(F.col("source_size"), F.col("target"), block)
    sources = sources.select("source_id", F.ceil(F.col("source_size") / words).alias("blocks"), want.alias("want"))
    sources = sources.filter("want > 0").withColumn("low", F.coalesce(F.sum("want").over(w), F.lit(0))).withColumn("high", F.col("low") + F.col("want"))
    sources = stored(sources, "wants")
    total = sources.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    draws = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("at"))
    drawn = _by_interval(draws, "at", sources.select("source_id", "low", "high"), "low", "high").select("shard", "slot", "source_id")
    drawn = stored(drawn, "draws")
    # the place of each draw among those of its source
    per_shard = drawn.groupBy("source_id", "shard").agg(F.count("*").alias("n"))
    ahead = before(per_shard, ["source_id"], "shard", "n", "ahead")
    inside = F.row_number().over(Window.partitionBy("source_id", "shard").orderBy("slot")) - 1
    placed = drawn.withColumn("inside", inside).join(ahead.select("source_id", "shard", "ahead"), ["source_id", "shard"]).withColumn("j", F.col("ahead") + F.col("inside"))
    got = per_shard.groupBy("source_id").agg(F.sum("n").alias("got"))
    books = sources.join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over, under = F.greatest(F.col("got") - F.col("want"), F.lit(0)), F.greatest(F.col("want") - F.col("got"), F.lit(0))
    books = books.withColumn("over", over).withColumn("under", under)
    books = books.withColumn("over_low", F.coalesce(F.sum("over").over(w), F.lit(0))).withColumn("under_low", F.coalesce(F.sum("under").over(w), F.lit(0)))
    books = stored(books, "books")
    placed = placed.select("shard", "slot", "source_id", "j").join(books.select("source_id", "want", "blocks", "over_low"), "source_id")
    fit = placed.filter(F.col("j") < F.col("want")).select("shard", "slot", "source_id", "j", "blocks")
    spare = placed.filter(F.col("j") >= F.col("want")).select("shard", "slot", (F.col("over_low") + F.col("j") - F.col("want")).alias("k"))
    lack = books.select("source_id", "blocks", "got", F.col("under_low").alias("low"), (F.col("under_low") + F.col("under")).alias("high"))
    given = _by_interval(spare, "k", lack, "low", "high").select("shard", "slot", "source_id", (F.col("got") + F.col("k") - F.col("low")).alias("j"), "blocks")
    full = fit.unionByName(given)
    index, turn = F.pmod("j", "blocks"), F.floor(F.col("j") / F.col("blocks"))
    return full.select("shard", "slot", "source_id", turn.alias("turn"), permuted(index, F.col("blocks"), F.xxhash64(F.lit(seed), "source_id")).alias("block"))


def streams(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, per_bucket: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): each row with its size and the place where it starts in its source's stream."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"))
    rows = stored(rows, "sizes")
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    bits = bucket_bits(rows.count(), per_bucket)
    rows = rows.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", hash_bucket(F.col("h"), bits))
    per = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    per = before(per, ["source_id"], "bucket", "words", "ahead").select("source_id", "bucket", "ahead")
    w = Window.partitionBy("source_id", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(per, ["source_id", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    return rows.select("doc_id", "source_id", "source_size", "target", "size", "h", "start"), sources


def pieces(rows: DataFrame, sources: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The rows, one for each block that they touch: low, high (words of the row) and times taken."""
    taken = slots(sources, seed, block).groupBy("source_id", "block").agg(F.count("*").alias("times"))
    words = F.col("words")
    rows = rows.filter("size > 0").withColumn("words", block_of(F.col("source_size"), F.col("target"), block)[0])
    touched = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words))))
    low = F.greatest(F.col("block") * words - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * words - F.col("start"), F.col("size"))
    return touched.join(taken, ["source_id", "block"], "left").withColumn("low", low).withColumn("high", high).withColumn("times", F.coalesce("times", F.lit(0))).drop("words")


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes from each row.

    A null source is a source of its own. Null and empty texts have no words and give none.
    Rows that repeat doc_id and text lie side by side in the stream. No rows: no rows. Extra
    columns are not read.
    """
    rows, sources = streams(docs)
    rows = stored(rows, "starts")
    # a row with words has a start of its own in its source
    key = ["doc_id", "source_id", "source_size", "target", "size", "start"]
    found = pieces(rows, sources, seed, block).groupBy(*key).agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    empty = rows.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return found.unionByName(empty).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row's text appears once for the words taken once or more, and once
    again for those taken twice. Whole texts stay as they are; parts are joined by one space."""
    docs = docs.select(*DOCUMENT)
    rows, sources = streams(docs)
    part = F.struct("low", "high", "times")
    got = pieces(rows, sources, seed, block).filter("times > 0").groupBy("doc_id", "h", "start", "size").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    got = got.withColumn("turn", F.explode(F.sequence(F.lit(1), F.array_max(F.col("parts.times")))))
    got = got.withColumn("parts", F.filter("parts", lambda p: p["times"] >= F.col("turn")))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["high"] - p["low"]) == F.col("size")
    got = got.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "parts", whole.alias("whole"))
    # rows that repeat doc_id and text stand for each other: one carries the text to all takes
    texts = docs.withColumn("_h", F.xxhash64("doc_id", "text"))
    texts = texts.groupBy("doc_id", "_h").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "_h", "row.*")
    both = texts.join(got, (texts["_h"] == got["_h"]) & texts.doc_id.eqNullSafe(got["_id"])).withColumn("words", F.split(F.btrim("text", F.lit(SPACE)), SPACE_RUN))
    cut = F.concat_ws(" ", F.flatten(F.transform("parts", lambda p: F.slice("words", p["low"].cast("int") + 1, (p["high"] - p["low"]).cast("int")))))
    both = both.withColumn("text", F.when(F.col("whole"), F.col("text")).otherwise(cut))
    return both.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op8_mixing(spark, sf_dir) -> DataFrame:
    return mix(documents(spark, sf_dir))
