"""Climate summaries per site: roster, normals, period comparison, event anomaly, trend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reaction_norms.functions.columns import coefficient_of_variation, mean

# Site codes and the climate variables summarised.
GARDENS = ("N_garden", "C_garden", "S_garden")
MEANS = {
    "hist_MAP": "MAP",
    "hist_PPT_wt": "PPT_wt",
    "hist_MAT": "MAT",
    "hist_Tmax_sm": "Tmax_sm",
    "hist_CMD": "CMD",
}
CVS = {"cv_MAP": "MAP", "cv_PPTwt": "PPT_wt", "cv_MAT": "MAT"}
PERIODS = {"historical": (1981, 2010), "contemporary": (2011, 2017)}


def site_roster(
    climate: DataFrame, gardens: Sequence[str] = GARDENS, site: str = "ID1"
) -> DataFrame:
    """Distinct sites with coordinates and their role."""
    role = F.when(F.col(site).isin(*gardens), "common garden").otherwise("focal population")
    return climate.select(site, "Latitude", "Longitude").distinct().withColumn("ID", role)


def focal_sites(
    climate: DataFrame, gardens: Sequence[str] = GARDENS, site: str = "ID1"
) -> DataFrame:
    """Rows of source populations only. A missing site is dropped, as by a row filter."""
    return climate.where(~F.col(site).isin(*gardens)) if gardens else climate


def _summaries(means: Mapping[str, str], cvs: Mapping[str, str], na_rm: bool) -> list:
    return [mean(c, na_rm).alias(n) for n, c in means.items()] + [
        coefficient_of_variation(c).alias(n) for n, c in cvs.items()
    ]


def climate_normals(
    climate: DataFrame,
    by: str = "ID1",
    means: Mapping[str, str] = MEANS,
    cvs: Mapping[str, str] = CVS,
    years: tuple[int, int] | None = None,
    na_rm: bool = False,
) -> DataFrame:
    """Per-site means and coefficients of variation over an inclusive year range."""
    rows = climate if years is None else climate.where(F.col("Year").between(*years))
    return rows.groupBy(by).agg(*_summaries(means, cvs, na_rm))


def compare_periods(
    climate: DataFrame,
    periods: Mapping[str, tuple[int, int]] = PERIODS,
    by: str = "ID1",
    cvs: Mapping[str, str] = CVS,
) -> DataFrame:
    """Long (site, period, cv...) table; one scan serves every period, overlaps included."""
    hits = [
        F.when(F.col("Year").between(lo, hi), F.lit(name)) for name, (lo, hi) in periods.items()
    ]
    lowest = min(lo for lo, _ in periods.values())
    highest = max(hi for _, hi in periods.values())
    return (
        climate.where(F.col("Year").between(lowest, highest))
        .select("*", F.explode(F.array_compact(F.array(*hits))).alias("period"))
        .groupBy(by, "period")
        .agg(*_summaries({}, cvs, True))
    )


def anomaly(
    climate: DataFrame,
    var: str = "PPT_wt",
    baseline: tuple[int, int] = (1981, 2010),
    event: tuple[int, int] = (2012, 2015),
    by: str = "ID1",
) -> DataFrame:
    """Event-year mean minus baseline mean, per (site, year).

    A site without event years keeps one row with a missing year; a site without
    a baseline is dropped (left join from the baseline). Rows are first reduced to
    one per site-year, so the per-site window holds calendar years, not raw rows.
    """
    year = F.col("Year")
    in_base, in_event = year.between(*baseline), year.between(*event)
    cells = (
        climate.where(in_base | in_event)
        .groupBy(by, "Year")
        .agg(
            F.sum(var).alias("_s"), F.count(var).alias("_k"), F.count(F.lit(1)).alias("_n")
        )
    )
    site = Window.partitionBy(by)
    base = lambda c: F.sum(F.when(in_base, F.col(c))).over(site)
    scored = cells.select(
        by,
        "Year",
        in_event.alias("_event"),
        F.when(F.col("_k") == F.col("_n"), F.try_divide("_s", "_n")).alias("_mean"),
        base("_n").alias("_base_n"),
        F.when(base("_k") == base("_n"), F.try_divide(base("_s"), base("_n"))).alias("baseline_mean"),
        F.max(in_event).over(site).alias("_has_event"),
        F.row_number().over(site.orderBy("Year")).alias("_rn"),
    )
    kept = scored.where(
        F.col("_base_n").isNotNull()
        & (F.col("_event") | (~F.col("_has_event") & (F.col("_rn") == 1)))
    )
    event_mean = F.when(F.col("_event"), F.col("_mean"))
    return kept.select(
        by,
        F.when(F.col("_event"), year).alias("Year"),
        "baseline_mean",
        event_mean.alias("event_mean"),
        (event_mean - F.col("baseline_mean")).alias("anomaly"),
    )


def mean_anomaly(anomalies: DataFrame, by: str = "ID1") -> DataFrame:
    """Per-site mean anomaly, missing years skipped."""
    return anomalies.groupBy(by).agg(F.avg("anomaly").alias("mean_anomaly"))


def smooth_trend(
    df: DataFrame, x: str, y: str, by: str, span: float = 0.75, n: int = 80
) -> DataFrame:
    """Local quadratic regression of y on x per site, on ``n`` evenly spaced points.

    Tricube weights over the nearest ``floor(span * points)`` values (Cleveland 1979),
    evaluated directly at every grid point; a package that interpolates its fitted
    surface between a few vertices differs slightly. Equal x values of a site are first
    merged to (count, mean), which leaves every weighted moment unchanged, so a group
    holds distinct x values (calendar years) only.
    """
    points = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(by, F.col(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).cast("double").alias("_c"), F.avg(y).alias("_y"))
    )
    site = Window.partitionBy(by)
    ranged = points.select(
        "*",
        F.min("_x").over(site).alias("_lo"),
        F.max("_x").over(site).alias("_hi"),
        F.sum("_c").over(site).alias("_total"),
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n - 1))
    spread = ranged.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    spread = spread.withColumn("_x0", F.col("_lo") + F.col("i") * step)
    spread = spread.withColumn("_d", F.abs(F.col("_x") - F.col("_x0")))
    near = (
        Window.partitionBy(by, "i")
        .orderBy("_d")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    q = F.least(F.floor(F.col("_total") * F.lit(span) + F.lit(1e-5)), F.col("_total"))
    reach = F.min(F.when(F.col("_cum") >= q, F.col("_d"))).over(Window.partitionBy(by, "i"))
    weighted = (
        spread.withColumn("_cum", F.sum("_c").over(near))
        .withColumn("_h", reach)
        .withColumn("_u", F.try_divide(F.col("_d"), F.col("_h")))
    )
    w = F.when(
        F.col("_u") < 1, F.col("_c") * F.pow(1 - F.pow(F.col("_u"), F.lit(3.0)), F.lit(3.0))
    ).otherwise(0.0)
    # Distances in units of the neighbourhood keep the 3 x 3 system well scaled.
    t = F.try_divide(F.col("_x") - F.col("_x0"), F.col("_h"))
    moments = weighted.select(by, "i", "_x0", "_y", w.alias("_w"), t.alias("_t"))
    s = [F.sum(F.col("_w") * F.pow(F.col("_t"), F.lit(float(k)))).alias(f"_s{k}") for k in range(5)]
    r = [
        F.sum(F.col("_w") * F.col("_y") * F.pow(F.col("_t"), F.lit(float(k)))).alias(f"_r{k}")
        for k in range(3)
    ]
    fit = moments.groupBy(by, "i").agg(F.max("_x0").alias(x), *s, *r)
    s0, s1, s2, s3, s4 = (F.col(f"_s{k}") for k in range(5))
    r0, r1, r2 = (F.col(f"_r{k}") for k in range(3))
    c0, c1, c2 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    det = s0 * c0 + s1 * c1 + s2 * c2
    at_zero = r0 * c0 + r1 * c1 + r2 * c2
    smooth = F.when(F.abs(det) > 1e-12, at_zero / det)
    return fit.select(by, "i", x, smooth.alias("smooth"))
