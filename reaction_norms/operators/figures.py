"""Statistics behind the figures: box summaries, densities, intervals and ribbons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reaction_norms.functions.columns import censor
from reaction_norms.functions.lookup import with_levels
from reaction_norms.functions.quantiles import draw_quantiles, exact_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_summary(
    df: DataFrame, value: str, by: Sequence[str], limits: tuple[float, float] | None = None
) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR, and counts per group of factor columns.

    ``limits`` drops values outside an axis range before any statistic. Groups may hold
    any number of rows: the quartiles come from ``exact_quantiles``. The input is read
    three times, so store a derived one first (``session.materialize``).
    """
    shown = censor(value, *limits) if limits else F.col(value)
    rows = df.select(*by, shown.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    quartiles = exact_quantiles(rows, "_v", QUARTILES, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        with_levels(rows, quartiles, by, list(QUARTILES))
        .groupBy(*by)
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            *[F.max(q).alias(q) for q in QUARTILES],
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def _bandwidth(n, sd, iqr):
    """Rule of thumb 0.9 * min(sd, IQR / 1.34) * n^(-1/5); a zero IQR falls back to sd."""
    narrow = F.least(sd, iqr / 1.34)
    spread = F.when(narrow > 0, narrow).when(sd > 0, sd).otherwise(F.lit(1.0))
    return 0.9 * spread * F.pow(n.cast("double"), F.lit(-0.2))


def density_curve(
    draws: DataFrame,
    value: str,
    by: Sequence[str] = (),
    n: int = 512,
    joint_bandwidth: bool = False,
    pad: float = 0.0,
    bins: int | None = None,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Gaussian kernel density per group on ``n`` shared points over the overall range.

    ``limits`` drops values outside an axis range before any statistic.
    ``joint_bandwidth`` uses the mean bandwidth of the groups; ``pad`` widens the range by
    that many bandwidths (the mean one). Groups are contrasts or cells, with a bounded
    number of draws. ``bins`` first spreads every value linearly over that many bins of
    its group's range, so a group of any size costs one pass plus ``bins * n`` terms.
    """
    by = list(by)
    keyed = draws if by else draws.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    shown = censor(value, *limits) if limits else F.col(value)
    rows = keyed.select(*keys, shown.cast("double").alias("_v")).where("_v is not null")
    ends = {"_q1": 0.25, "_q3": 0.75}
    spans = [
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    ]
    if bins is None:
        stats = draw_quantiles(rows, "_v", ends, keys, spans)
    else:
        quartiles = exact_quantiles(rows, "_v", ends, keys)
        stats = with_levels(rows.groupBy(*keys).agg(*spans), quartiles, keys, list(ends))
    own = stats.withColumn(
        "_bw", _bandwidth(F.col("_n"), F.col("_sd"), F.col("_q3") - F.col("_q1"))
    )
    overall = own.agg(
        F.struct(
            F.min("_lo").alias("lo"),
            F.max("_hi").alias("hi"),
            F.avg("_bw").alias("bw"),
        )
    ).scalar()

    own = own.select(*keys, F.struct("_n", "_bw", "_lo", "_hi").alias("_own"))
    placed = with_levels(rows, own, keys, ["_own"])
    if bins is None:
        weighted = placed.withColumn("_w", F.lit(1.0))
    else:
        width = F.try_divide(F.col("_own._hi") - F.col("_own._lo"), F.lit(float(bins - 1)))
        at = F.coalesce(F.try_divide(F.col("_v") - F.col("_own._lo"), width), F.lit(0.0))
        low = F.floor(at)
        two = F.array(
            F.struct(low.alias("b"), (1 - (at - low)).alias("w")),
            F.struct((low + 1).alias("b"), (at - low).alias("w")),
        )
        binned = (
            placed.select(*keys, F.explode(two).alias("_b"))
            .where(F.col("_b.w") > 0)
            .groupBy(*keys, F.col("_b.b").alias("_bin"))
            .agg(F.sum("_b.w").alias("_w"))
        )
        weighted = with_levels(binned, own, keys, ["_own"]).withColumn(
            "_v",
            F.col("_own._lo")
            + F.col("_bin") * (F.col("_own._hi") - F.col("_own._lo")) / F.lit(float(bins - 1)),
        )
    ready = weighted.withColumn("_o", overall)
    bw = F.col("_o.bw") if joint_bandwidth else F.col("_own._bw")
    low, high = F.col("_o.lo") - pad * F.col("_o.bw"), F.col("_o.hi") + pad * F.col("_o.bw")
    spread = ready.select(
        *keys,
        "_v",
        "_w",
        F.col("_own._n").alias("_n"),
        bw.alias("_bw"),
        low.alias("_low"),
        ((high - low) / F.lit(float(n - 1))).alias("_step"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"),
    )
    x = F.col("_low") + F.col("i") * F.col("_step")
    u = (x - F.col("_v")) / F.col("_bw")
    kernel = F.col("_w") * F.exp(-0.5 * u * u) / (F.col("_n") * F.col("_bw") * F.sqrt(2 * F.pi()))
    curve = spread.groupBy(*keys, "i").agg(
        F.max(x).alias("x"), F.sum(kernel).alias("density")
    )
    return curve.select(*by, "i", "x", "density")


def density_ridges(
    draws: DataFrame, value: str, by: Sequence[str], n: int = 512, bins: int | None = None,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Densities per contrast with one joint bandwidth, over the range widened by 3 bandwidths."""
    return density_curve(draws, value, by, n, joint_bandwidth=True, pad=3.0, bins=bins, limits=limits)


def interval_summary(
    draws: DataFrame, value: str, by: Sequence[str], widths: Sequence[float] = (0.66, 0.95),
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Median and quantile intervals per group, one row per interval width; ``limits`` drops
    values outside an axis range first."""
    if limits:
        draws = draws.where(F.col(value).between(*limits))
    ends = {}
    for i, w in enumerate(widths):
        ends[f"_lo{i}"], ends[f"_hi{i}"] = (1 - w) / 2, (1 + w) / 2
    rows = draw_quantiles(draws, value, {"median": 0.5, **ends}, by)
    parts = [
        F.struct(
            F.lit(w).alias("width"),
            F.col(f"_lo{i}").alias("lower"),
            F.col(f"_hi{i}").alias("upper"),
        )
        for i, w in enumerate(widths)
    ]
    return rows.select(*by, "median", F.inline(F.array(*parts)))


def ribbon(
    effects: DataFrame, x: str, value: str = "value", by: Sequence[str] = ("Population", "Year"),
    width: float = 0.5, significant_only: bool = True,
) -> DataFrame:
    """Median and interval of the fitted draws at every grid point of the significant groups."""
    shown = effects.where(F.col("sig") == "Significant") if significant_only else effects
    probs = {"lower": (1 - width) / 2, "median": 0.5, "upper": (1 + width) / 2}
    return draw_quantiles(shown, value, probs, [*by, "i"], [F.max(x).alias(x)])
