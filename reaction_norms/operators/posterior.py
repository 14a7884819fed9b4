"""Tables computed from posterior draws: marginal means, contrasts, summaries, slopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.functions import columns as C
from reaction_norms.functions.lookup import with_levels
from reaction_norms.functions.quantiles import draw_quantiles
from reaction_norms.operators import reshape as R


def subsample_draws(draws: DataFrame, n: int = 1000, seed: int = 123) -> DataFrame:
    """A reproducible subset of draws: the n smallest digests of (seed, draw)."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string")))
    return draws.orderBy(key, "draw").limit(n)


def marginal(cells: DataFrame, keep: Sequence[str], value: str = "prediction") -> DataFrame:
    """Average the cells of each draw over every factor not kept."""
    return cells.groupBy("draw", *keep).agg(F.avg(value).alias("marginal_prediction"))


def cohort_contrast(cells: DataFrame, first: str = "2010", second: str = "2017") -> DataFrame:
    """First minus second cohort per draw, averaged over populations.

    Partial sums per cohort in one aggregate: one shuffle on the draw.
    """
    year = F.col("Year").cast("string")
    mean_of = lambda y: F.avg(F.when(year == y, F.col("prediction")))
    return cells.groupBy("draw").agg((mean_of(first) - mean_of(second)).alias("diff_prediction"))


def population_contrast(
    cells: DataFrame, contrasts: Sequence[R.Contrast] | None = None
) -> DataFrame:
    """Population differences per draw (averaged over cohorts), long."""
    contrasts = contrasts or R.population_contrasts()
    wide = cells.groupBy("draw").agg(
        *[
            F.avg(F.when(F.col("Population") == p, F.col("prediction"))).alias(p)
            for p in R.contrast_cells(contrasts)
        ]
    )
    return R.contrasts_from_wide(wide, contrasts, name="difference", value="pred_diff")


def cell_contrast(cells: DataFrame, contrasts: Sequence[R.Contrast] | None = None) -> DataFrame:
    """Population-cohort differences per draw, long."""
    contrasts = contrasts or R.cell_contrasts()
    wide = R.to_wide(
        cells, ["draw"], ["Population", "Year"], R.contrast_cells(contrasts), "prediction"
    )
    return R.contrasts_from_wide(wide, contrasts)


def probability_of_difference(
    diffs: DataFrame, value: str, by: Sequence[str] = (), na_rm: bool = False
) -> DataFrame:
    """Shares above and below zero and the larger of the two, per contrast."""
    above, below, larger = C.probability_of_difference(value, na_rm)
    return diffs.groupBy(*by).agg(
        above.alias("prob_greater_than_zero"),
        below.alias("prob_less_than_zero"),
        larger.alias("probability"),
    )


def join_probability(diffs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Every draw of a contrast with its probabilities."""
    stats = probability_of_difference(diffs, value, by)
    cols = ["prob_greater_than_zero", "prob_less_than_zero", "probability"]
    return with_levels(diffs, stats, by, cols)


def contrast_stars(
    diffs: DataFrame, var: str = "var", value: str = "dif", keep: Sequence[str] | None = None
) -> DataFrame:
    """Mean difference, probability and stars per contrast, with its population.

    ``keep`` defaults to the cohort contrasts within a population.
    """
    if keep is None:
        keep = [n for n, a, b in R.cell_contrasts() if a.split("_")[0] == b.split("_")[0]]
    above, below, larger = C.probability_of_difference(value)
    stats = (
        diffs.where(F.col(var).isin(*keep))
        .groupBy(var)
        .agg(
            C.mean(value).alias("mean_diff"),
            above.alias("prob_greater_than_zero"),
            below.alias("prob_less_than_zero"),
            larger.alias("prob_diff_from_zero"),
        )
    )
    return stats.select(
        "*",
        C.stars("prob_diff_from_zero").alias("significance"),
        C.first_population(var).alias("Population"),
    )


def cell_summary(cells: DataFrame, value: str = "prediction") -> DataFrame:
    """Median and 95 % interval per population x cohort."""
    probs = {"median": 0.5, "lower": 0.025, "upper": 0.975}
    return draw_quantiles(cells, value, probs, ["Population", "Year"])


def coefficient_summary(draws: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Estimate, error and 95 % interval of every term and of sigma."""
    names = F.array(*[F.lit(t) for t in (*terms, "sigma")])
    values = F.concat(F.col("beta"), F.array("sigma"))
    long = draws.select(F.posexplode(values).alias("idx", "v"))
    return draw_quantiles(
        long,
        "v",
        {"lower": 0.025, "upper": 0.975},
        ["idx"],
        [F.avg("v").alias("estimate"), F.stddev_samp("v").alias("est_error")],
    ).select(
        "idx",
        F.element_at(names, F.col("idx") + 1).alias("term"),
        "estimate",
        "est_error",
        "lower",
        "upper",
    )


def slope_table(slopes: DataFrame, trait_label: str) -> DataFrame:
    """Median slope and 95 % interval per population from long slope draws."""
    probs = {"linear_median": 0.5, "linear_lower": 0.025, "linear_upper": 0.975}
    return draw_quantiles(slopes, "slope", probs, ["Population"]).withColumn(
        "trait", F.lit(trait_label)
    )


def reference_population(levels: DataFrame, terms: DataFrame) -> DataFrame:
    """Populations without a term of their own: declared levels minus those seen in names."""
    seen = F.regexp_extract("name", r"^Population([^:]+)", 1)
    named = terms.select(seen.alias("Population")).where(F.col("Population") != "").distinct()
    return levels.select("Population").where(F.col("Population").isNotNull()).subtract(named)


def slope_probability(trends: DataFrame) -> DataFrame:
    """Mean slope and probability that it differs from zero per population x cohort."""
    above, below, larger = C.probability_of_difference("value")
    return trends.groupBy("Population", "Year").agg(
        F.avg("value").alias("mean_slope"),
        above.alias("prob_greater_than_zero"),
        below.alias("prob_less_than_zero"),
        larger.alias("prob_diff_from_zero"),
    )


def join_significance(effects: DataFrame, slope_probs: DataFrame) -> DataFrame:
    """Fitted draws with the probability and the significance label of their cell."""
    cell = C.key_text("Population", "Year")
    joined = with_levels(
        effects.withColumn("pop_year", cell),
        slope_probs.withColumn("pop_year", cell),
        ["pop_year"],
        ["prob_diff_from_zero"],
    )
    # A missing probability is neither label.
    return joined.withColumn("sig", C.significance("prob_diff_from_zero"))
