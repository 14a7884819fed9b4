"""Replicate gates, plasticity indices and sample sizes.

Everything derives from one small table: per (trait, family, population, cohort,
garden) the replicate count, sum and minimum. It is built with map-side partial
aggregation, so a family holding a third of all plants reaches the shuffle as one
row per task. Gates, garden minima, global means and the index itself are computed
from those cells; the plants are not read or shuffled again, and the quadratic
replicate-pair table is never needed for the index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reaction_norms.functions.columns import key_text
from reaction_norms.functions.lookup import with_levels
from reaction_norms.sources.facts import JoinedPlants

#: A table of plants, or measurements and families that are joined after they are reduced.
Plants = DataFrame | JoinedPlants

# Factor levels of the study design.
POPULATIONS = ("N1", "N2", "C1", "C2", "S1", "S2")
COHORTS = (2010, 2017)


@dataclass(frozen=True)
class Trait:
    """A measured trait and the garden pairs it is compared over, greater mean first."""

    name: str
    column: str
    label: str
    pairs: tuple[tuple[str, str], ...]
    centered: bool = False
    min_reps: int = 2

    @property
    def envs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(env for pair in self.pairs for env in pair))


# Subtraction directions, trait columns and labels.
DOY = Trait(
    "doy",
    "first_flower_doy",
    "First flower date plasticity",
    (("north", "south"), ("north", "center"), ("south", "center")),
    centered=True,
)
SLA = Trait("sla", "sla_cm2_per_g", "SLA plasticity", (("south", "north"),))
LDMC = Trait("ldmc", "ldmc", "LDMC plasticity", (("north", "south"),))
TRAITS = (DOY, SLA, LDMC)

FAMILY = ("trait", "Dam_ID")
CELL = (*FAMILY, "Population", "Year")


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _by_trait(traits: Sequence[Trait], expr) -> Column:
    """``expr(trait)`` chosen by the row's ``trait`` column."""
    if len(traits) == 1:
        return expr(traits[0])
    out = None
    for t in traits:
        hit = F.col("trait") == t.name
        out = F.when(hit, expr(t)) if out is None else out.when(hit, expr(t))
    return out


def _moments(*parts: Column) -> Column:
    return F.array(*[p.cast("double") for p in parts])


def cell_moments(plants: Plants, *traits: Trait) -> DataFrame:
    """Per (trait, family, population, cohort, garden): ``m = [n, sum, min]``.

    All traits are reduced in one aggregate, one hash lookup per plant, and split into
    rows afterwards. The not-null filter reaches the scan.
    """
    cols = {t.name: F.col(t.column).cast("double") for t in traits}
    measured = reduce(lambda a, b: a | b, [F.col(t.column).isNotNull() for t in traits])
    wide = (
        plants.where(measured)
        .groupBy(*CELL[1:], "garden")
        .agg(*[_moments(F.count(c), F.sum(c), F.min(c)).alias(f"_m_{n}") for n, c in cols.items()])
    )
    if len(traits) == 1:
        name = traits[0].name
        return wide.select(F.lit(name).alias("trait"), *CELL[1:], "garden", F.col(f"_m_{name}").alias("m"))
    rows = F.array(
        *[F.struct(F.lit(n).alias("trait"), F.col(f"_m_{n}").alias("m")) for n in cols]
    )
    return wide.select(*CELL[1:], "garden", F.inline(rows)).where(F.col("m")[0] > 0)


# --------------------------------------------------------------------------- gates


def replicate_counts(plants: Plants, trait: Trait) -> DataFrame:
    """Measured plants per garden x family x cohort."""
    return (
        plants.where(F.col(trait.column).isNotNull())
        .groupBy("garden", "Dam_ID", "Year")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def replicate_counts_wide(plants: Plants, trait: Trait) -> DataFrame:
    """Replicates per garden beside each other, per eligible family x population x cohort.

    A garden without plants is missing, as after a full outer merge of the counts.
    """
    reps = lambda e: F.sum(F.when(F.col("garden") == e, F.col("m")[0]))
    return (
        gated_cells(plants, trait)
        .groupBy(*CELL[1:])
        .agg(*[reps(e).cast("bigint").alias(f"{e}_reps") for e in trait.envs])
    )


def gate_table(plants: Plants, trait: Trait) -> DataFrame:
    """Per family x cohort: 0/1 per garden with enough replicates, and ``both`` for all.

    A garden without any plant counts as 0, not as missing.
    """
    enough = {
        env: (F.count_if(F.col("garden") == env) >= trait.min_reps).cast("int").alias(f"N_{env}")
        for env in trait.envs
    }
    both = F.when(_all([F.col(f"N_{env}") > 0 for env in trait.envs]), 1).otherwise(0)
    return (
        plants.where(F.col(trait.column).isNotNull())
        .groupBy("Dam_ID", "Year")
        .agg(*enough.values())
        .withColumn("both", both)
    )


def gate_frequency(gates: DataFrame) -> DataFrame:
    """How many family x cohort groups pass and fail."""
    return gates.groupBy("both").agg(F.count(F.lit(1)).alias("n"))


def eligible_families(plants: Plants, trait: Trait) -> DataFrame:
    """Families with enough replicates in every garden in at least one cohort."""
    return gate_table(plants, trait).where("both = 1").select("Dam_ID").distinct()


def semi_join(df: DataFrame, keys: DataFrame, on: str, null_safe: bool = True) -> DataFrame:
    """Rows whose key is in the list; with ``null_safe`` a NULL key matches a NULL key."""
    listed = keys.select(F.col(on).alias("_key"))
    same = F.col(on).eqNullSafe(F.col("_key")) if null_safe else F.col(on) == F.col("_key")
    return df.join(listed, same, "left_semi")


def eligible_plants(plants: Plants, trait: Trait, null_safe: bool = True) -> DataFrame:
    """Measured plants of eligible families, from every cohort of the family."""
    measured, families = plants.where(F.col(trait.column).isNotNull()), eligible_families(plants, trait)
    if isinstance(measured, JoinedPlants):
        return measured.in_families(families, null_safe)
    return semi_join(measured, families, "Dam_ID", null_safe)


def gate_cells(cells: DataFrame, traits: Sequence[Trait]) -> DataFrame:
    """Cells of eligible families, from every cohort of the family.

    The moments travel as one array, so every reader of the cells asks the first
    shuffle for the same columns and Spark reuses it instead of scanning again. The
    second shuffle, of cells only, serves both windows and the family totals. The
    windows hold the cells of one family: traits x populations x cohorts x gardens.
    """
    cohort, family = Window.partitionBy(*FAMILY, "Year"), Window.partitionBy(*FAMILY)
    envs = dict.fromkeys(env for t in traits for env in t.envs)
    reps = {
        env: F.coalesce(
            F.sum(F.when(F.col("garden") == env, F.col("m")[0])).over(cohort), F.lit(0.0)
        )
        for env in envs
    }
    passes = _by_trait(traits, lambda t: _all([reps[e] >= t.min_reps for e in t.envs]))
    return (
        cells.repartition("Dam_ID")
        .select("*", passes.alias("_year_ok"))
        .select(*CELL, "garden", "m", F.max("_year_ok").over(family).alias("_ok"))
        .where("_ok")
        .drop("_ok")
    )


def gated_cells(plants: Plants, *traits: Trait) -> DataFrame:
    """Moments of the eligible families' cells, straight from the plants."""
    return gate_cells(cell_moments(plants, *traits), traits)


# --------------------------------------------------------------------- environments


def center_on_env_min(
    df: DataFrame, trait: str, env: str = "garden", out: str = "transplant_DOY"
) -> DataFrame:
    """Subtract each environment's minimum."""
    minima = df.groupBy(env).agg(F.min(trait).alias("_min"))
    lowest = with_levels(df, minima, [env], ["_min"])
    return lowest.withColumn(out, F.col(trait) - F.col("_min")).drop("_min")


def _env_sums(cells: DataFrame, traits: Sequence[Trait]) -> DataFrame:
    """Per trait and garden: replicate count, minimum and sum after centring."""
    sums = cells.groupBy("trait", "garden").agg(
        F.sum(F.col("m")[0]).alias("n"),
        F.sum(F.col("m")[1]).alias("s"),
        F.min(F.col("m")[2]).alias("lo"),
    )
    shift = _by_trait(traits, lambda t: F.col("lo") if t.centered else F.lit(0.0))
    return sums.withColumn("lo", shift).withColumn("s", F.col("s") - F.col("n") * F.col("lo"))


def env_means(plants: Plants, trait: Trait) -> DataFrame:
    """Mean (centred) trait per garden over the eligible plants."""
    sums = _env_sums(gated_cells(plants, trait), [trait])
    return sums.select("garden", F.try_divide("s", "n").alias(f"{trait.name}_mean"))


#: Environments in a block of ``subtraction_pairs``.
BLOCK = 500


def subtraction_pairs(means: DataFrame, mean_col: str, env: str = "garden") -> DataFrame:
    """Environment pairs with the greater mean first (equal means: the greater name), from a one-row-per-level table.

    Levels are dealt out to blocks of about ``BLOCK``, and every pair of blocks is a join key of its own, so
    a pair of levels is made in one of many tasks and no task holds more than two blocks.
    """
    rows = means.where(F.col(mean_col).isNotNull()).select(F.col(env).alias("e"), F.col(mean_col).alias("v"))
    blocks = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias("n")).scalar()
    rows = rows.withColumn("_n", blocks).withColumn("own", F.pmod(F.xxhash64("e"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    first = rows.select("e", "v", F.col("own").alias("a"), other.alias("b"))
    second = rows.select(F.col("e").alias("e2"), F.col("v").alias("v2"), other.alias("a2"), F.col("own").alias("b2"))
    greater = (F.col("v") > F.col("v2")) | ((F.col("v") == F.col("v2")) & (F.coalesce("e", F.lit("")) > F.coalesce("e2", F.lit(""))))
    met = first.join(second, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & greater)
    return met.select(
        F.col("e").alias("garden_1"),
        F.col("e2").alias("garden_2"),
        F.col("v").alias("mean_1"),
        F.col("v2").alias("mean_2"),
    )


def with_found_pairs(plants: Plants, trait: Trait) -> Trait:
    """The trait with its subtraction directions taken from the data (one small job)."""
    col = f"{trait.name}_mean"
    rows = (
        env_means(plants, trait)
        .where(F.col("garden").isin(*trait.envs) & F.col(col).isNotNull())
        .collect()
    )
    order = [r["garden"] for r in sorted(rows, key=lambda r: -r[col])]
    pairs = tuple((a, b) for i, a in enumerate(order) for b in order[i + 1 :])
    return Trait(trait.name, trait.column, trait.label, pairs, trait.centered, trait.min_reps)


# ------------------------------------------------------------------------- index


def _trait_scale(cells: DataFrame, traits: Sequence[Trait]) -> Column:
    """One scalar struct per query: each trait's global mean and centring shifts."""
    sums = _env_sums(cells, traits)
    parts = []
    for t in traits:
        mine = lambda c, t=t: F.when(F.col("trait") == t.name, F.col(c))
        parts.append(F.try_divide(F.sum(mine("s")), F.sum(mine("n"))).alias(f"mean_{t.name}"))
        parts += [
            F.max(F.when(F.col("garden") == e, mine("lo"))).alias(f"lo_{t.name}_{e}") for e in t.envs
        ]
    return sums.agg(F.struct(*parts).alias("scale")).scalar()


def _family_sums(
    cells: DataFrame,
    traits: Sequence[Trait],
    populations: Sequence[str] | None,
    years: Sequence[int] | None,
    sizes: bool = False,
) -> DataFrame:
    """Second gate on gated cells: one row per family x population x cohort with the
    replicate count, centred sum and centring shift per garden, and the global mean.
    ``sizes`` adds a fourth moment, the number of distinct values per garden.

    A missing family is part of the first gate and of the global mean, but is not a
    family of its own here, and only declared populations and cohorts are indexed.
    """
    envs = list(dict.fromkeys(env for t in traits for env in t.envs))
    pick = lambda env, i: F.sum(F.when(F.col("garden") == env, F.col("m")[i]))
    family = cells.groupBy(*CELL).agg(
        *[F.coalesce(pick(e, 0), F.lit(0.0)).alias(f"n_{e}") for e in envs],
        *[pick(e, 1).alias(f"s_{e}") for e in envs],
        *[pick(e, 3).alias(f"d_{e}") for e in envs if sizes],
    )
    enough = _by_trait(traits, lambda t: _all([F.col(f"n_{e}") >= t.min_reps for e in t.envs]))
    pop, year = F.col("Population"), F.col("Year")
    # The family test is tied to the counts, so that it stays above the shared shuffle.
    kept = (
        F.when(F.col("Dam_ID").isNull(), False).otherwise(enough)
        & (pop.isin(*populations) if populations else pop.isNotNull())
        & (year.isin(*years) if years else year.isNotNull())
    )
    low = {
        e: _by_trait(
            traits,
            lambda t, e=e: F.col("_scale")[f"lo_{t.name}_{e}"] if e in t.envs else F.lit(0.0),
        )
        for e in envs
    }
    return (
        family.where(kept)
        .select("*", _trait_scale(cells, traits).alias("_scale"))
        .select(
            *CELL,
            *[F.col(f"n_{e}") for e in envs],
            *[(F.col(f"s_{e}") - F.col(f"n_{e}") * low[e]).alias(f"s_{e}") for e in envs],
            *[low[e].alias(f"lo_{e}") for e in envs],
            *[F.col(f"d_{e}") for e in envs if sizes],
            _by_trait(traits, lambda t: F.col("_scale")[f"mean_{t.name}"]).alias("global_mean"),
        )
    )


def _pair_sum(a: str, b: str) -> Column:
    """Sum of x_a - x_b over all replicate pairs, from counts and sums."""
    return F.col(f"n_{b}") * F.col(f"s_{a}") - F.col(f"n_{a}") * F.col(f"s_{b}")


def _pair_count(a: str, b: str) -> Column:
    return F.col(f"n_{a}") * F.col(f"n_{b}")


def pair_totals(
    plants: Plants,
    trait: Trait,
    populations: Sequence[str] | None = POPULATIONS,
    years: Sequence[int] | None = COHORTS,
) -> DataFrame:
    """Per family and garden pair: number of replicate pairs and their mean difference.

    The pair table summed up, in closed form: linear in the number of plants.
    """
    family = _family_sums(gated_cells(plants, trait), [trait], populations, years)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("garden_1"),
                    F.lit(b).alias("garden_2"),
                    _pair_count(a, b).cast("bigint").alias("n_pairs"),
                    F.try_divide(_pair_sum(a, b), _pair_count(a, b)).alias("mean_difference"),
                )
                for a, b in trait.pairs
            ]
        )
    )
    return family.select(
        "Dam_ID",
        key_text("Population", "Year").alias("pop_year"),
        "global_mean",
        rows.alias("_p"),
    ).select(
        "Dam_ID",
        "pop_year",
        "_p.*",
        F.try_divide(F.col("_p.mean_difference"), F.col("global_mean")).alias("mean_ratio"),
    )


def plasticity_indices(
    plants: Plants,
    traits: Sequence[Trait] = TRAITS,
    populations: Sequence[str] | None = POPULATIONS,
    years: Sequence[int] | None = COHORTS,
) -> DataFrame:
    """Long (trait, Dam_ID, pop_year, Population, Year, plasticity, global_mean) in one scan."""
    family = _family_sums(gated_cells(plants, *traits), traits, populations, years)
    total = lambda t, f: reduce(lambda x, y: x + y, [f(a, b) for a, b in t.pairs])
    index = _by_trait(
        traits,
        lambda t: F.try_divide(
            F.try_divide(total(t, _pair_sum), total(t, _pair_count)), F.col("global_mean")
        ),
    )
    return family.select(
        "trait",
        "Dam_ID",
        key_text("Population", "Year").alias("pop_year"),
        "Population",
        F.col("Year").cast("string").alias("Year"),
        index.alias("plasticity"),
        "global_mean",
    )


def plasticity_index(
    plants: Plants,
    trait: Trait,
    populations: Sequence[str] | None = POPULATIONS,
    years: Sequence[int] | None = COHORTS,
) -> DataFrame:
    """Family plasticity: mean over all replicate differences, relative to the global mean."""
    return plasticity_indices(plants, [trait], populations, years).select(
        "Dam_ID",
        "pop_year",
        "Population",
        "Year",
        F.col("plasticity").alias(f"{trait.name}_plasticity"),
    )


def mean_shift(
    plants: Plants,
    trait: Trait,
    populations: Sequence[str] | None = POPULATIONS,
    years: Sequence[int] | None = COHORTS,
) -> DataFrame:
    """Mean index, global mean and their product: the mean shift in trait units."""
    indices = plasticity_indices(plants, [trait], populations, years)
    return indices.agg(
        F.avg("plasticity").alias("mean_plasticity"), F.max("global_mean").alias("global_mean")
    ).withColumn("mean_shift", F.col("mean_plasticity") * F.col("global_mean"))


# -------------------------------------------------------------------------- pairs

CHUNK = 1_000


def _members(
    plants: Plants,
    t: Trait,
    populations: Sequence[str] | None,
    years: Sequence[int] | None,
) -> DataFrame:
    """Distinct centred values of valid families with their count ``c``, beside the
    family's counts, sums and number of distinct values per garden.

    Gates and means come from the same counted values, so the plants are read once and
    equal values of a family collapse before the first shuffle.
    """
    value = F.col(t.column).cast("double")
    values = (
        plants.where(F.col(t.column).isNotNull())
        .groupBy(*CELL[1:], "garden", value.alias("value"))
        .agg(F.count(F.lit(1)).alias("c"))
        .select(F.lit(t.name).alias("trait"), *CELL[1:], "garden", "value", "c")
    )
    moments = (F.sum("c"), F.sum(F.col("value") * F.col("c")), F.min("value"), F.count(F.lit(1)))
    cells = values.groupBy(*CELL, "garden").agg(_moments(*moments).alias("m"))
    families = _family_sums(gate_cells(cells, [t]), [t], populations, years, sizes=True)
    families = families.withColumnsRenamed({k: f"_{k}" for k in CELL})
    low = reduce(
        lambda acc, e: acc.when(F.col("garden") == e, F.col(f"lo_{e}")),
        t.envs[1:],
        F.when(F.col("garden") == t.envs[0], F.col(f"lo_{t.envs[0]}")),
    )
    return (
        values.join(families, _same_family())
        .drop(*[f"_{k}" for k in CELL])
        .withColumn("value", F.col("value") - low)
    )


def _same_family() -> Column:
    """Null-safe although valid keys are never missing: a plain join would push not-null
    filters into one branch only and so scan the plants twice."""
    return _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in CELL])


def _roles(members: DataFrame, t: Trait, position: int, *fields) -> DataFrame:
    """Members with each pair (a, b) in which their garden stands at the given position;
    ``fields(a, b)`` give further columns of the role."""
    roles = [
        F.when(
            F.col("garden") == pair[position],
            F.struct(F.lit(pair[0]).alias("a"), F.lit(pair[1]).alias("b"), *[f(*pair) for f in fields]),
        )
        for pair in t.pairs
    ]
    return members.select("*", F.explode(F.array_compact(F.array(*roles))).alias("p"))


def replicate_differences(
    plants: Plants,
    trait: Trait,
    populations: Sequence[str] | None = POPULATIONS,
    years: Sequence[int] | None = COHORTS,
) -> DataFrame:
    """Each value of the first garden against all replicates of the second: the pair table
    summed over its second replicate.

    One row per distinct value and direction, so it grows with the plants and not with
    their pairs. ``n_pairs`` counts the replicate pairs behind a row.
    """
    t = trait
    mean_of = lambda a, b: F.try_divide(F.col(f"s_{b}"), F.col(f"n_{b}")).alias("mean_2")
    count_of = lambda a, b: F.col(f"n_{b}").alias("n_2")
    rows = _roles(_members(plants, t, populations, years), t, 0, mean_of, count_of)
    difference = F.col("value") - F.col("p.mean_2")
    return rows.select(
        "Dam_ID",
        key_text("Population", "Year").alias("pop_year"),
        F.col("p.a").alias("garden_1"),
        F.col("p.b").alias("garden_2"),
        F.col("value").alias(f"{t.name}_1"),
        (F.col("c") * F.col("p.n_2")).cast("bigint").alias("n_pairs"),
        difference.alias("mean_difference"),
        F.try_divide(difference, F.col("global_mean")).alias("mean_ratio"),
    )


def pairwise_differences(
    plants: Plants,
    trait: Trait,
    populations: Sequence[str] | None = POPULATIONS,
    years: Sequence[int] | None = COHORTS,
) -> DataFrame:
    """The replicate-pair table, one row per pair of distinct values and its multiplicity.

    ``n_pairs`` says how many replicate pairs carry the row; repeating every row that
    often gives the plain table, so nothing is lost. It suits traits recorded in few
    distinct values (a day of year has at most 366, whatever the number of plants). For
    others its size is quadratic by definition: use ``plasticity_index``, ``pair_totals``
    or ``replicate_differences``, which are linear and hold all the index needs.

    A family with many distinct values is spread over ``ceil(values / CHUNK)`` join
    keys; ordinary families keep one.
    """
    t = trait
    members = _members(plants, t, populations, years)
    parts = lambda a, b: F.ceil(F.col(f"d_{a}") / CHUNK).cast("int").alias("parts")
    left = _roles(members, t, 0, parts).select(
        *CELL,
        "global_mean",
        F.col("value").alias("v1"),
        F.col("c").alias("c1"),
        "p.a",
        "p.b",
        F.pmod(F.xxhash64("value"), F.col("p.parts")).cast("int").alias("part"),
    )
    right = _roles(members, t, 1, parts).select(
        *[F.col(k).alias(f"_{k}") for k in CELL],
        F.col("value").alias("v2"),
        F.col("c").alias("c2"),
        F.col("p.a").alias("_a"),
        F.col("p.b").alias("_b"),
        F.explode(F.sequence(F.lit(0), F.col("p.parts") - 1)).alias("_part"),
    )
    matched = _all([_same_family(), *[F.col(c) == F.col(f"_{c}") for c in ("a", "b", "part")]])
    difference = F.col("v1") - F.col("v2")
    return left.join(right, matched).select(
        "Dam_ID",
        key_text("Population", "Year").alias("pop_year"),
        F.col("a").alias("garden_1"),
        F.col("b").alias("garden_2"),
        F.col("v1").alias(f"{t.name}_1"),
        F.col("v2").alias(f"{t.name}_2"),
        difference.alias("difference"),
        F.try_divide(difference, F.col("global_mean")).alias("ratio"),
        (F.col("c1") * F.col("c2")).alias("n_pairs"),
    )


# -------------------------------------------------------------------- sample sizes


def sample_sizes(plants: Plants, traits: Sequence[Trait] = TRAITS) -> DataFrame:
    """Eligible families and plants per trait x population x cohort, in one scan.

    Cells are unique per family, so families are counted without a distinct; a
    missing family counts as one, as in the counting it mirrors.
    """
    label = _by_trait(traits, lambda t: F.lit(t.label))
    return (
        gated_cells(plants, *traits)
        .groupBy(*CELL)
        .agg(F.sum(F.col("m")[0]).alias("_n"))
        .groupBy("trait", "Population", "Year")
        .agg(
            F.count(F.lit(1)).alias("n_families"),
            F.sum("_n").cast("bigint").alias("n_individuals"),
        )
        .withColumn("trait", label)
    )


def size_sketches(plants: Plants, traits: Sequence[Trait] = TRAITS, lg_k: int = 14) -> DataFrame:
    """Per trait x population x cohort: a sketch of the eligible families, and the number of their plants.

    The sketches of several runs or sites are saved as they are and united by ``united_sizes``, which counts
    a family that occurs in several of them once; neither needs the plants again.
    """
    # a missing family counts as one, apart from any name
    family = F.when(F.col("Dam_ID").isNull(), "missing").otherwise(F.concat(F.lit("family "), F.col("Dam_ID")))
    return (
        gated_cells(plants, *traits)
        .groupBy("trait", "Population", "Year")
        .agg(F.hll_sketch_agg(family, lg_k).alias("families"), F.sum(F.col("m")[0]).cast("bigint").alias("n_individuals"))
    )


def united_sizes(sketches: DataFrame, traits: Sequence[Trait] = TRAITS) -> DataFrame:
    """Sample sizes from any number of sketch tables: families estimated (relative standard error
    about 0.8 / sqrt(2 ^ lg_k), near exact while they are few), plants added up."""
    return (
        sketches.groupBy("trait", "Population", "Year")
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("families")).alias("n_families"),
            F.sum("n_individuals").alias("n_individuals"),
        )
        .withColumn("trait", _by_trait(traits, lambda t: F.lit(t.label)))
    )
