"""Lookups from factor-level tables.

Statistics per environment, per cell or per contrast have one row per factor level and reach
the data rows by a null-safe left join. Any number of levels is answered: adaptive execution
broadcasts the level table where its measured size allows, and splits skewed keys otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_levels(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Left join of a one-row-per-level table: adds its value columns to every row.

    Null keys match null keys; a key without a level gets nulls.
    """
    level = stats.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.col(v).alias(f"_of_{i}") for i, v in enumerate(values)],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    joined = df.join(level, reduce(lambda a, b: a & b, same), "left")
    return joined.select(*df.columns, *[F.col(f"_of_{i}").alias(v) for i, v in enumerate(values)])


def level_values(df: DataFrame, col: str) -> list:
    """Distinct non-null values of a factor column on the driver, sorted. For the factors of a
    model, whose terms are solved locally anyway; declare the levels to avoid the job."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
