"""Selection tables: fitness joined with plasticity, standardised, and prediction grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reaction_norms.functions.columns import even_grid, map_columns
from reaction_norms.operators.plasticity import TRAITS, Plants, Trait, plasticity_indices
from reaction_norms.session import materialize


def family_fitness(plants: Plants, fitness: str = "totalRS") -> DataFrame:
    """Mean fitness per family x population x cohort, missing plants skipped."""
    return plants.groupBy("Dam_ID", "Population", "Year").agg(F.avg(fitness).alias("mean_rs"))


def indices_by_trait(
    plants: Plants, traits: Sequence[Trait] = TRAITS
) -> dict[str, DataFrame]:
    """One index table per trait from a single scan of the plants, stored once.

    This is the hand-off table between the plasticity and the selection analyses.
    """
    stored = materialize(plasticity_indices(plants, traits).drop("global_mean"))
    return {
        t.name: stored.where(F.col("trait") == t.name).select(
            "Dam_ID", "pop_year", "Population", "Year", F.col("plasticity").alias(f"{t.name}_plasticity")
        )
        for t in traits
    }


def _left(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Left join in which missing keys match missing keys (``null_safe``); the right keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) if null_safe else F.col(c) == F.col(f"_r_{c}") for c in on]
    return left.join(renamed, same, "left").drop(*[f"_r_{c}" for c in on])


def join_traits(
    indices: Mapping[str, DataFrame], on: Sequence[str] = ("Dam_ID",), null_safe: bool = True
) -> DataFrame:
    """All plasticities left-joined onto the first trait's table (its families are kept).

    ``on`` defaults to the family alone; use ``("Dam_ID", "pop_year")`` to keep a family's
    cohorts apart. Without ``null_safe`` (an index has no missing family) tables in buckets of the
    family, ``sources.tables.replace_family_table``, are joined without a shuffle.
    """
    names = list(indices)
    root = indices[names[0]].select(
        "Dam_ID", "pop_year", "Population", "Year", F.col(f"{names[0]}_plasticity").alias(f"{names[0]}_pp")
    )
    for name in names[1:]:
        right = indices[name].select(*on, F.col(f"{name}_plasticity").alias(f"{name}_pp"))
        root = _left(root, right, on, null_safe)
    return root


def add_squares(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Quadratic terms, squared before any standardisation."""
    return df.select("*", *map_columns([f"{n}_pp" for n in names], lambda c: c * c, "{}2"))


def selection_table(
    plants: Plants,
    indices: Mapping[str, DataFrame],
    fitness: str = "totalRS",
    on: Sequence[str] = ("Dam_ID",),
) -> DataFrame:
    """One row per family: mean fitness, plasticities and their squares."""
    names = list(indices)
    traits = add_squares(join_traits(indices, on), names)
    cols = [f"{n}_pp" for n in names] + [f"{n}_pp2" for n in names]
    keyed = family_fitness(plants, fitness)
    if "pop_year" in on:
        keyed = keyed.withColumn("pop_year", F.concat_ws("-", "Population", F.col("Year").cast("string")))
    return _left(keyed, traits.select(*on, *cols), on).select(
        *cols, "mean_rs", "Population", "Year", "Dam_ID"
    )


def global_stats(df: DataFrame, cols: Sequence[str]) -> Column:
    """Mean and sd of several columns as one scalar struct: only partial sums are shuffled."""
    parts = [f(c).alias(f"{p}_{c}") for c in cols for p, f in (("avg", F.avg), ("sd", F.stddev_samp))]
    return df.agg(F.struct(*parts).alias("stats")).scalar()


def standardize(
    df: DataFrame,
    cols: Sequence[str],
    relative: Mapping[str, str] | None = None,
    names: str = "{}_z",
) -> DataFrame:
    """Global z-scores, and columns divided by their global mean (``{new: old}``)."""
    relative = dict(relative or {})
    stats = global_stats(df, list(dict.fromkeys([*cols, *relative.values()])))
    out = df.withColumn("_stats", stats)
    z = [
        F.try_divide(F.col(c) - F.col(f"_stats.avg_{c}"), F.col(f"_stats.sd_{c}")).alias(names.format(c))
        for c in cols
    ]
    rel = [
        F.try_divide(F.col(old), F.col(f"_stats.avg_{old}")).alias(new) for new, old in relative.items()
    ]
    return out.select(*df.columns, *z, *rel)


def standardized_selection(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Selection table with z-scored plasticities and squares, and relative fitness."""
    cols = [f"{n}_pp" for n in names] + [f"{n}_pp2" for n in names]
    return standardize(table, cols, {"fitness_rel": "mean_rs"})


def observed_range(
    df: DataFrame, x: str, by: Sequence[str] = ("Population", "Year")
) -> DataFrame:
    """Observed minimum and maximum of x per group."""
    return df.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def restricted_grid(
    df: DataFrame, x: str, by: Sequence[str] = ("Population", "Year"), n: int = 100
) -> DataFrame:
    """Evenly spaced prediction points over each group's observed range."""
    ranges = observed_range(df, x, by).where(F.col("lo").isNotNull())
    return ranges.select(*by, F.posexplode(even_grid("lo", "hi", n)).alias("i", x))
