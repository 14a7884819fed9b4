"""Shared helpers: input columns, stored tables, and word splitting."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a scratch folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = _local_folder()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    return written(df, name, codec)[0]


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``stored`` with the table's path, for ``discard``."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ``written`` whose successor is written and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def process_cache() -> dict:
    """What a worker process keeps from task to task. Task code is shipped by value, so its own globals begin anew."""
    return vars(sys.modules.setdefault("_llm_process_cache", ModuleType("_llm_process_cache")))


def by_batch(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str) -> DataFrame:
    """Apply a function of Arrow batches to every batch, in place."""

    def run(batches):
        for batch in batches:
            out = rows(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def bisect(edges: Column, n: int, value: Column) -> Column:
    """Number of the n ascending edges that are below the value (edge < value), in log2(n) steps."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(edges, at + step - 1) < value), at + step).otherwise(at))


def bucket_bits(n: int, per_bucket: int) -> int:
    """Bits of a hash that deal n rows into buckets of about per_bucket."""
    return max(1, (n // per_bucket).bit_length())


def hash_bucket(h: Column, bits: int) -> Column:
    """The leading bits of a signed hash: buckets ascend with it."""
    return F.shiftright(h, 64 - bits)


def before(df: DataFrame, group: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Running sum of ``value`` over the rows of a group with a lesser ``order`` (a long), in two
    levels: inside blocks of ``width`` order values, and over the totals of the blocks."""
    from pyspark.sql import Window

    df = df.withColumn("_block", F.floor(F.col(order) / width))
    totals = df.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_block", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, [*group, "_block"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_block", "_base")


_BASE = 0x9E3779B97F4A7C15


def rolling_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k consecutive values (unsigned 64-bit), none where there are fewer.

    Hashes of 1, 2, 4, ... values are joined to k by its binary digits; a last step mixes bits.
    """
    if len(values) < k:
        return np.empty(0, np.uint64)
    total, h, width, done = None, values, 1, 0
    while True:
        if k & width:
            total = h if total is None else total[: len(h) - done] * np.uint64(pow(_BASE, width, 1 << 64)) + h[done:]
            done += width
        if 2 * width > k:
            break
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    total = total[: len(values) - k + 1]
    total = (total ^ (total >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    total = (total ^ (total >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return total ^ (total >> np.uint64(33))


_REACH = 1 << 24
_LOWER, _UPPER = np.uint64(_REACH - 1), np.uint64(((1 << 40) - 1) << 24)


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Place of the least hash (by its upper 40 bits) in each window, the rightmost of equal ones."""
    found = [np.empty(0, np.int64)]
    # hash above, place from the end below: the least number is the rightmost least hash
    for start in range(0, len(h) - window + 1, _REACH - window + 1):
        piece = h[start : start + _REACH]
        least, width = (piece & _UPPER) | np.arange(_REACH - 1, _REACH - 1 - len(piece), -1, dtype=np.uint64), 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        found.append(start + _REACH - 1 - (least & _LOWER).astype(np.int64))
    return np.concatenate(found)


def sorted_runs(batches: Iterator[pa.RecordBatch], n_key: int, least: int = 2) -> Iterator[list[np.ndarray]]:
    """The runs of equal leading columns that hold ``least`` rows or more, from sorted batches of integers."""
    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(rest, columns)]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:n_key]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(new)]
        sizes = np.diff(starts)
        for s, k in zip(starts[:-1][sizes >= least].tolist(), sizes[sizes >= least].tolist()):
            yield [c[s : s + k] for c in columns]
        rest = [c[starts[-1] :] for c in columns]
    if rest is not None and len(rest[0]) >= least:
        yield rest
