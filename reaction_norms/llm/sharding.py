"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 7).

Keys lie on a ring, each shard owns many points of it, and a key belongs to the shard at the
next point clockwise. A shard takes keys up to its bound; keys that find it full go on
clockwise to the next shard with room. The ring is worked out on counts per arc (as many as
points); rows then find their rank within the arc and with it their shard and slot.
DataFrame functions only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reaction_norms.llm.common import bisect, bucket_bits, documents, hash_bucket, stored

SHARDS, POINTS = 8, 64


def ring(spark: SparkSession, shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    shard, copy = (F.col("id") % shards).cast("int"), F.floor(F.col("id") / shards)
    # a point's place knows its own shard only, so that another shard leaves the others' points alone
    rows = spark.range(shards * points).select(shard.alias("shard"), F.xxhash64(F.lit("point"), shard, copy).alias("at"))
    return sorted((r["at"], r["shard"]) for r in rows.collect())


def bounds(n: int, shards: int, slack: float) -> list[int]:
    """Most keys of each shard. Without slack the bounds add up to n and differ by one at most."""
    if slack:
        return [ceil((1 + slack) * n / shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def spread(counts: dict[int, int], owners: list[int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first_slot): where the keys of each arc go.

    All arcs offer their keys to their first shard, then what it could not take to the next
    shard clockwise, and so on; a full shard takes arcs in ring order.
    """
    shards, room = len(caps), list(caps)
    placed, taken = [], dict.fromkeys(counts, 0)
    ways = {}
    for arc in counts:
        way = []
        for i in range(len(owners)):
            if (s := owners[(arc + i) % len(owners)]) not in way:
                way.append(s)
                if len(way) == shards:
                    break
        ways[arc] = way
    for level in range(shards):
        for arc in sorted(counts):
            if level < len(ways[arc]) and (left := counts[arc] - taken[arc]):
                shard = ways[arc][level]
                if n := min(left, room[shard]):
                    placed.append((arc, taken[arc], taken[arc] + n, shard, caps[shard] - room[shard]))
                    room[shard] -= n
                    taken[arc] += n
    return placed


def ring_shards(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = 0.0, per_bucket: int = 5000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    With ``slack`` 0 shards differ by one row at most. The ring key is a hash of doc_id and of
    the text's checksum, so null or repeated ids spread; rows that repeat both are told apart by
    arbitrary rank, with equal outcome. A null text has size 1 and the checksum of an empty
    one. No rows: no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    nodes = ring(spark, shards, points)
    key = F.xxhash64("doc_id", "text_crc32")
    arc = bisect(F.array(*[F.lit(at) for at, _ in nodes]), len(nodes), F.col("h")) % len(nodes)
    rows = stored(rows.withColumn("h", key).withColumn("arc", arc.cast("int")), "keys")
    n = rows.count()
    rows = rows.withColumn("bucket", hash_bucket(F.col("h"), bucket_bits(n, per_bucket)))
    # the first arc holds both ends of the ring: hashes past the last point come after the others
    per = rows.groupBy("arc", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("arc", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    plan = spread(counts, [s for _, s in nodes], bounds(n, shards, slack))
    # at most arcs x shards rows
    plan = spark.createDataFrame(plan, "arc int, low long, high long, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("arc", "bucket").orderBy("h", "doc_id", "size")) - 1
    ranked = rows.join(per, ["arc", "bucket"]).withColumn("rank", F.col("ahead") + rank)
    placed = ranked.join(F.broadcast(plan), (ranked.arc == plan.arc) & (ranked.rank >= plan.low) & (ranked.rank < plan.high))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))


def op7_sharding(spark, sf_dir) -> DataFrame:
    return ring_shards(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
