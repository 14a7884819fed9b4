"""Wide/long reshaping, factor cells and named contrasts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Contrast = tuple[str, str, str]

LEVELS_PER_BLOCK = 1_000

# Order in which populations are compared, and the cohorts.
CONTRAST_POPULATIONS = ("N1", "N2", "C1", "C2", "S1", "S2")
CONTRAST_COHORTS = ("2010", "2017")


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long: one row per (id, column)."""
    return df.unpivot(list(ids), list(cols), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], names_from: Sequence[str], values: Sequence[str], value: str,
    sep: str = "_",
) -> DataFrame:
    """Long to wide over declared names; one conditional aggregate, one shuffle on the ids."""
    key = F.concat_ws(sep, *[F.col(c).cast("string") for c in names_from])
    keyed = df.select(*ids, key.alias("_k"), F.col(value).alias("_v"))
    return keyed.groupBy(*ids).agg(
        *[F.max(F.when(F.col("_k") == v, F.col("_v"))).alias(v) for v in values]
    )


def level_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every combination of the observed levels of factor columns, missing ones excluded.

    Each further column's levels are dealt into blocks of about ``LEVELS_PER_BLOCK``, and every
    row meets every block by an equi-join, so any number of levels is answered.
    """
    first, *rest = cols
    out = df.select(first).where(F.col(first).isNotNull()).distinct()
    for c in rest:
        levels = df.select(c).where(F.col(c).isNotNull()).distinct()
        blocks = levels.agg(F.ceil(F.greatest(F.count(c), F.lit(1)) / LEVELS_PER_BLOCK).alias("n")).scalar()
        dealt = levels.withColumn("_block", F.pmod(F.xxhash64(c), blocks))
        met = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        out = met.join(dealt, "_block").drop("_block")
    return out


def population_contrasts(populations: Sequence[str] = CONTRAST_POPULATIONS) -> list[Contrast]:
    """Every population pair, named ``left_right``."""
    return [(f"{a}_{b}", a, b) for a, b in combinations(populations, 2)]


def cell_contrasts(
    populations: Sequence[str] = CONTRAST_POPULATIONS, cohorts: Sequence[str] = CONTRAST_COHORTS
) -> list[Contrast]:
    """Population pairs within each cohort, then the cohorts of each population."""
    within = [
        (f"{a}_{y}", f"{b}_{y}") for y in cohorts for a, b in combinations(populations, 2)
    ]
    across = [(f"{p}_{y}", f"{p}_{z}") for p in populations for y, z in combinations(cohorts, 2)]
    return [(f"{left}-{right}", left, right) for left, right in within + across]


def contrast_cells(contrasts: Sequence[Contrast]) -> list[str]:
    return list(dict.fromkeys(c for _, left, right in contrasts for c in (left, right)))


def contrasts_from_wide(
    wide: DataFrame, contrasts: Sequence[Contrast], ids: Sequence[str] = ("draw",),
    name: str = "var", value: str = "dif",
) -> DataFrame:
    """Named differences of wide columns, long; no join."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias(name), (F.col(a) - F.col(b)).alias(value)) for n, a, b in contrasts]
    )
    return wide.select(*ids, F.inline(pairs).alias(name, value))


def contrasts_from_long(
    df: DataFrame, key: str, value_col: str, contrasts: Sequence[Contrast],
    ids: Sequence[str] = ("draw",), name: str = "var", value: str = "dif",
) -> DataFrame:
    """The same from long cells, without declaring a wide row: each cell is sent to the
    contrasts it takes part in with its sign, and one aggregate sums them."""
    roles = [
        F.when(F.col(key) == cell, F.struct(F.lit(n).alias("n"), F.lit(sign).alias("s")))
        for n, a, b in contrasts
        for cell, sign in ((a, 1.0), (b, -1.0))
    ]
    sent = df.select(*ids, F.col(value_col).alias("_v"), F.explode(F.array_compact(F.array(*roles))).alias("r"))
    whole = F.count("_v") == 2
    return sent.groupBy(*ids, F.col("r.n").alias(name)).agg(
        F.when(whole, F.sum(F.col("_v") * F.col("r.s"))).alias(value)
    )
