"""Gaussian linear models from sufficient statistics, and their posterior draws.

The data are read once, in a distributed aggregate (``fit_all``); its result
has one row per factor cell whatever the data size. The closed-form solve of a matrix
of at most a few dozen columns is local. Draws are built-in expressions of the draw number
(``Posterior.draws``); code that needs them inside a task computes the same ones there
(``Posterior.sample``), so no draw passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reaction_norms.functions.lookup import with_levels
from reaction_norms.functions.quantiles import exact_quantiles
from reaction_norms.models.design import Design
from reaction_norms.models.numbers import digest, literal, normals, normals_of, remembered, uniform, uniforms_of
from reaction_norms.sources.schemas import DRAWS, TERMS


@dataclass(frozen=True)
class Prior:
    """Normal priors on intercept (of centred predictors) and slopes, exponential on sigma."""

    intercept_mean: float = 1.0
    intercept_sd: float = 1.0
    slope_mean: float = 0.0
    slope_sd: float = 2.0
    sigma_rate: float = 1.0


@dataclass(frozen=True)
class StudentPrior:
    """Student-t prior on the intercept (of centred predictors), flat slopes, half Student-t on sigma."""

    location: float
    scale: float
    dof: float = 3.0


# The priors of the selection models; what the plasticity models get where no prior is
# named (a scale of 2.5 at least; the factor makes a median absolute deviation a standard
# deviation). ``None`` is the flat prior.
SELECTION_PRIOR = Prior()
LEAST_SCALE = 2.5
MAD_FACTOR = 1.4826
SEED = 123
N_DRAWS = 8_000
DRAWS_PER_TASK = 1_000
SIGMA_POINTS = 1_000
#: Places of random numbers that one attempt at a draw takes.
ATTEMPT_PLACES = 1_000


def default_prior(df: DataFrame, design: Design) -> StudentPrior:
    """The prior of a model without a named one: around the median of the response, as wide as its
    median absolute deviation, both to one decimal. Two passes; no group is gathered."""
    y = design.complete_cases(df).select(F.col(design.response).cast("double").alias("y"))
    middle = exact_quantiles(y, "y", {"m": 0.5}, []).first()
    if middle is None:
        raise ValueError("no complete rows to fit")
    spread = exact_quantiles(y.select(F.abs(F.col("y") - F.lit(middle["m"])).alias("y")), "y", {"m": 0.5}, []).first()
    return StudentPrior(round(middle["m"], 1), max(LEAST_SCALE, round(MAD_FACTOR * spread["m"], 1)))


def _times(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``rows @ matrix``, summed in the order of the columns, so that a row's result does not
    depend on the rows beside it."""
    out = np.zeros((len(rows), matrix.shape[1]))
    for column, weights in zip(rows.T, matrix):
        out += column[:, None] * weights
    return out


@dataclass(frozen=True)
class Posterior:
    """A joint density of (sigma, beta) that draws are taken from directly.

    The logarithm of sigma comes from a table of its distribution function. Given sigma,
    ``beta = mix @ v`` with independent normal ``v``: precision ``own + data / sigma^2``, mean
    ``(pull + fit / sigma^2) / precision``. A Student-t prior on the intercept of centred
    predictors is met by rejection: a draw is kept with the chance of its density
    against that of the prior's mode, the first of ``attempts`` that is kept counts.
    """

    log_sigma: np.ndarray
    cdf: np.ndarray
    mix: np.ndarray
    own: np.ndarray
    data: np.ndarray
    pull: np.ndarray
    fit: np.ndarray
    center: np.ndarray
    intercept: StudentPrior | None = None
    attempts: int = 1

    def draws(self, spark: SparkSession, n: int = N_DRAWS, seed: int = SEED, partitions: int | None = None) -> DataFrame:
        """Draws 1 to n (draw, beta, sigma): built-in expressions of the draw number.

        The number of tasks follows the number of draws, not the size of the cluster.
        """
        p, zero = len(self.own), F.lit(0.0)
        rows = spark.range(1, n + 1, 1, partitions or -(-n // DRAWS_PER_TASK)).withColumnRenamed("id", "draw")
        tries = F.sequence(F.lit(0), F.lit(self.attempts - 1))
        rows = rows.withColumn("_try", F.explode(tries)) if self.attempts > 1 else rows.withColumn("_try", F.lit(0))
        first = F.col("_try") * ATTEMPT_PLACES
        rows = rows.withColumn("_h", digest(seed, F.col("draw"), first))
        rows = rows.withColumn("_u", uniform(F.col("_h"), 0))
        rows = rows.withColumn("sigma", F.exp(_interpolated(F.col("_u"), self.cdf, self.log_sigma)))
        rows = rows.withColumn("_z", normals(seed, F.col("draw"), first + 1, p))
        own, data, pull, fit = (literal(x) for x in (self.own, self.data, self.pull, self.fit))
        s2 = F.col("sigma") * F.col("sigma")
        terms = F.zip_with(F.zip_with(own, data, lambda a, b: a + b / s2), F.zip_with(pull, fit, lambda a, b: a + b / s2), lambda k, m: F.struct(k.alias("k"), m.alias("m")))
        rows = rows.withColumn("_v", F.zip_with("_z", terms, lambda z, t: t["m"] / t["k"] + z / F.sqrt(t["k"])))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda t, x: t + x)
        rows = rows.withColumn("beta", F.transform(literal(self.mix), lambda row: dot(row, F.col("_v"))))
        if self.intercept is not None:
            t = self.intercept
            away = (dot(literal(self.center), F.col("beta")) - t.location) / t.scale
            chance = F.pow(1 + away * away / t.dof, F.lit(-(t.dof + 1) / 2))
            # the last attempt stands for itself: attempts are as many as make its use next to impossible.
            # (No filter: it would be pushed below the steps, with all of them written out in it.)
            kept = (F.col("_try") == self.attempts - 1) | (uniform(F.col("_h"), 1) <= chance)
            rows = rows.withColumn("_kept", F.when(kept, F.col("_try")))
            rows = rows.groupBy("draw").agg(F.min_by(F.struct("beta", "sigma"), "_kept").alias("_d")).select("draw", "_d.*")
        return rows.select("draw", "beta", "sigma")

    def sample(self, seed: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(beta, sigma) of the given draws, the same as ``draws`` but for the last bits."""
        p = len(self.own)
        beta, sigma, left = np.empty((len(ids), p)), np.empty(len(ids)), np.arange(len(ids))
        for attempt in range(self.attempts):
            first = attempt * ATTEMPT_PLACES
            u = uniforms_of(seed, ids[left], range(first, first + 1 + (p + 1) // 2))
            s = np.exp(np.interp(u[:, 0, 0], self.cdf, self.log_sigma))
            precision = self.own + self.data / s[:, None] ** 2
            v = (self.pull + self.fit / s[:, None] ** 2) / precision + normals_of(u[:, 1:], p) / np.sqrt(precision)
            b = _times(v, self.mix.T)
            kept = np.ones(len(left), bool)
            if self.intercept is not None and attempt < self.attempts - 1:
                t = self.intercept
                away = (b @ self.center - t.location) / t.scale
                kept = u[:, 0, 1] <= (1 + away**2 / t.dof) ** (-(t.dof + 1) / 2)
            beta[left[kept]], sigma[left[kept]] = b[kept], s[kept]
            left = left[~kept]
            if not len(left):
                break
        return beta, sigma

    def drawn(self, n: int = N_DRAWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(beta, sigma) of draws 1 to n, computed once in a worker process."""
        key = (n, seed, self.mix.tobytes(), self.fit.tobytes(), self.cdf.tobytes(), self.attempts)
        return remembered(key, lambda: self.sample(seed, np.arange(1, n + 1)))


def _interpolated(u, xs: np.ndarray, ys: np.ndarray):
    """Linear interpolation of ys over ascending xs, at u between its ends, by halving."""
    n, x, y = len(xs), literal(xs), literal(ys)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range((n - 1).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= n - 2) & (F.get(x, i + step) <= u), i + step).otherwise(i))
    line = F.transform(
        F.array(at),
        lambda i: F.get(y, i) + (F.get(y, i + 1) - F.get(y, i)) * F.coalesce(F.try_divide(u - F.get(x, i), F.get(x, i + 1) - F.get(x, i)), F.lit(0.0)),
    )
    return F.get(line, 0)


def _sigma_table(log_density, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(log sigma, distribution function) on a grid that covers the bulk of a density of log sigma.

    A coarse grid around ``scale`` finds the bulk; a fine one covers it.
    """
    coarse = np.log(scale) + np.linspace(-9, 3, SIGMA_POINTS)
    logp = log_density(coarse)
    bulk = np.flatnonzero(logp > logp.max() - 40)
    low, high = coarse[max(bulk[0] - 1, 0)], coarse[min(bulk[-1] + 1, SIGMA_POINTS - 1)]
    grid = np.linspace(low, high, SIGMA_POINTS)
    logp = log_density(grid)
    weight = np.exp(logp - logp.max())
    cdf = np.concatenate([[0.0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return grid, cdf / cdf[-1]


@dataclass(frozen=True)
class GaussianFit:
    """A fitted model: the design and its cross products."""

    design: Design
    n: int
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    prior: Prior | StudentPrior | None = None

    @property
    def x_mean(self) -> np.ndarray:
        return self.xtx[0] / self.n

    def least_squares(self) -> tuple[np.ndarray, float]:
        """Coefficients and residual variance under the flat prior."""
        p = len(self.xty)
        if self.n <= p:
            raise ValueError(f"{self.n} complete rows cannot fit {p} terms under a flat prior")
        beta = np.linalg.solve(self.xtx, self.xty)
        return beta, float((self.yty - beta @ self.xty) / (self.n - p))

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.design.terms)), TERMS)

    def posterior(self) -> Posterior:
        return _normal_posterior(self) if isinstance(self.prior, Prior) else _flat_posterior(self)

    def draws(self, spark: SparkSession, n: int = N_DRAWS, seed: int = SEED, partitions: int | None = None) -> DataFrame:
        """Independent posterior draws, the same for any number of partitions."""
        return self.posterior().draws(spark, n, seed, partitions)


def _flat_posterior(fit: GaussianFit) -> Posterior:
    """Flat coefficients, and sigma under its Jeffreys prior or a half Student-t one.

    Draws are made in terms of each population's slopes and cells: the slopes first, then the cells
    given the slopes. These terms are independent across populations.
    """
    beta, s2 = fit.least_squares()
    p = len(beta)
    by_cell = fit.design.cell_terms()
    back = np.linalg.inv(by_cell)
    precision = back.T @ fit.xtx @ back
    # precision = upper @ upper.T with an upper triangle, so that each term builds on those before
    upper = np.linalg.cholesky(precision[::-1, ::-1])[::-1, ::-1]
    t = fit.prior
    dof, rss = fit.n - p, (fit.n - p) * s2

    def log_density(log_sigma: np.ndarray) -> np.ndarray:
        flat = -dof * log_sigma - rss / 2 * np.exp(-2 * log_sigma)
        if t is None:
            return flat
        # the density of sigma itself, in place of 1 / sigma
        return flat + log_sigma - (t.dof + 1) / 2 * np.log1p(np.exp(2 * log_sigma) / (t.dof * t.scale**2))

    zero, one = np.zeros(p), np.ones(p)
    log_sigma, cdf = _sigma_table(log_density, np.sqrt(s2))
    out = Posterior(log_sigma, cdf, back @ np.linalg.inv(upper).T, zero, one, zero, upper.T @ by_cell @ beta, fit.x_mean, t)
    if t is None:
        return out
    # the chance that an attempt is kept, over the intercept's posterior under a flat prior
    nodes, weights = np.polynomial.hermite_e.hermegauss(41)
    share = np.diff(cdf)
    sigma = np.exp((log_sigma[1:] + log_sigma[:-1]) / 2)
    away = (fit.x_mean @ beta + nodes * sigma[:, None] / np.sqrt(fit.n) - t.location) / t.scale
    kept = float(share @ ((1 + away**2 / t.dof) ** (-(t.dof + 1) / 2) @ (weights / weights.sum())))
    attempts = 1 + int(np.ceil(np.log(1e-12) / np.log1p(-min(kept, 1 - 1e-9))))
    if attempts > 1_000:
        raise ValueError(f"the data lie far out in the prior of the intercept: one attempt in {1 / kept:.0f} is kept")
    return Posterior(**{**vars(out), "attempts": attempts})


def _normal_posterior(fit: GaussianFit) -> Posterior:
    """Informative prior: sigma from its one-dimensional marginal, then beta given sigma.

    Predictors are centred; scaling by the prior sd and rotating to the eigenvectors of
    the scaled cross products makes beta given sigma independent normals.
    """
    prior, n, p = fit.prior, fit.n, len(fit.xty)
    center = np.eye(p)
    center[0, 1:] = -fit.x_mean[1:]  # design @ center has centred columns
    gram = center.T @ fit.xtx @ center
    gram[0, 1:] = gram[1:, 0] = 0.0
    cross = center.T @ fit.xty
    sd = np.full(p, prior.slope_sd)
    mu = np.full(p, prior.slope_mean)
    sd[0], mu[0] = prior.intercept_sd, prior.intercept_mean
    values, vectors = np.linalg.eigh(sd[:, None] * gram * sd)
    values = np.clip(values, 0.0, None)
    data_part = vectors.T @ (sd * cross)
    prior_part = vectors.T @ (mu / sd)

    def log_density(log_sigma: np.ndarray) -> np.ndarray:
        s2 = np.exp(2 * log_sigma)
        precision = 1.0 + values / s2[:, None]
        mean = (data_part / s2[:, None] + prior_part) / precision
        return (
            (1 - n) * log_sigma
            - 0.5 * np.log(precision).sum(axis=1)
            + 0.5 * (precision * mean**2).sum(axis=1)
            - fit.yty / (2 * s2)
            - prior.sigma_rate * np.exp(log_sigma)
        )

    y_sd = np.sqrt(max(fit.yty / n - (fit.xty[0] / n) ** 2, 1e-12))
    log_sigma, cdf = _sigma_table(log_density, y_sd)
    mix = center @ (sd[:, None] * vectors)
    return Posterior(log_sigma, cdf, mix, np.ones(p), values, prior_part, data_part, fit.x_mean)


def fit_all(
    df: DataFrame, designs: Mapping[str, Design], prior: Prior | StudentPrior | None = None
) -> dict[str, GaussianFit]:
    """Fit several models in one distributed pass; missing rows are dropped listwise.

    The aggregate has one row per population x cohort of the designs and is combined before its shuffle,
    so a cell holding a third of all rows is one partial row per task.
    """
    some = reduce(lambda a, b: a | b, [d.is_complete() for d in designs.values()])
    rows = (
        df.where(some)
        .groupBy("Population", F.col("Year").cast("string").alias("Year"))
        .agg(*[d.moments().alias(name) for name, d in designs.items()])
        .collect()
    )
    return {
        name: _assemble(d, [(r["Population"], r["Year"], r[name]) for r in rows if r[name]["n"]], prior)
        for name, d in designs.items()
    }


def fit_gaussian(df: DataFrame, design: Design, prior: Prior | StudentPrior | None = None) -> GaussianFit:
    """Fit one model by one distributed pass."""
    return fit_all(df, {"model": design}, prior)["model"]


def _assemble(design: Design, cells: Sequence[tuple], prior: Prior | StudentPrior | None) -> GaussianFit:
    """Cross products of the design from the moments of its cells."""
    if not cells:
        raise ValueError("no complete rows to fit")
    p, k = len(design.terms), len(design.covariates)
    xtx, xty, yty, total = np.zeros((p, p)), np.zeros(p), 0.0, 0
    for population, year, m in cells:
        n = m["n"]
        mean = np.array([m[f"m{i}"] for i in range(k + 1)])
        cov = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = m[f"c{i}_{j}"]
        # Cross products of (1, covariates, response) in this cell.
        cross = np.empty((k + 2, k + 2))
        cross[0, 0] = n
        cross[0, 1:] = cross[1:, 0] = n * mean
        cross[1:, 1:] = n * (cov + np.outer(mean, mean))
        spread = np.zeros((p, k + 1))
        for i, covariate in design.active(population, year).items():
            spread[i, 0 if covariate is None else 1 + design.covariates.index(covariate)] = 1.0
        xtx += spread @ cross[:-1, :-1] @ spread.T
        xty += spread @ cross[:-1, -1]
        yty += cross[-1, -1]
        total += n
    return GaussianFit(design, int(total), xtx, xty, float(yty), prior)


# ------------------------------------------------------------------ expected values


def expected_cells(draws: DataFrame, design: Design) -> DataFrame:
    """Expected value of every population x cohort cell per draw (covariates at 0)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("Population"),
                F.lit(y).alias("Year"),
                design.cell_value(p, y).alias("prediction"),
            )
            for p, y in design.cells()
        ]
    )
    return draws.select("draw", F.inline(cells))


def slope_draws(draws: DataFrame, design: Design, covariate: str) -> DataFrame:
    """Per-population slope of a covariate per draw: main effect plus interaction."""
    year = design.years[0]
    slopes = F.array(
        *[
            F.struct(F.lit(p).alias("Population"), design.cell_slope(p, year, covariate).alias("slope"))
            for p in design.populations
        ]
    )
    return draws.select("draw", F.inline(slopes))


def trend_draws(draws: DataFrame, design: Design, covariate: str) -> DataFrame:
    """Slope of a covariate per population x cohort and draw; equal across cohorts by design."""
    slopes = F.array(
        *[
            F.struct(
                F.lit(p).alias("Population"),
                F.lit(y).alias("Year"),
                design.cell_slope(p, y, covariate).alias("value"),
            )
            for p, y in design.cells()
        ]
    )
    return draws.select("draw", F.inline(slopes))


def conditional_effects(
    draws: DataFrame, design: Design, covariate: str, ranges: DataFrame, n: int = 100
) -> DataFrame:
    """Fitted values of every draw along each cell's observed covariate range.

    ``ranges`` has one row per cell (Population, Year, lo, hi). Work is spread over the
    draws. Other covariates are held at 0, their mean after standardisation.
    """
    at_zero = F.array(
        *[
            F.struct(
                F.lit(p).alias("Population"),
                F.lit(y).alias("Year"),
                design.cell_value(p, y).alias("base"),
                design.cell_slope(p, y, covariate).alias("slope"),
            )
            for p, y in design.cells()
        ]
    )
    cells = with_levels(
        draws.select("draw", F.inline(at_zero)),
        ranges.withColumn("Year", F.col("Year").cast("string")),
        ["Population", "Year"],
        ["lo", "hi"],
    )
    points = cells.where(F.col("lo").isNotNull()).select(
        "draw", "Population", "Year", "base", "slope", "lo", "hi",
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"),
    )
    x = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(float(n - 1))
    return points.withColumn("x", x).select(
        "draw", "Population", "Year", "i", F.col("x").alias(covariate),
        (F.col("base") + F.col("slope") * F.col("x")).alias("value"),
    )


def fitted_values(
    df: DataFrame, fit: GaussianFit, keep: Sequence[str] = (), width: float = 0.95, n: int = N_DRAWS, seed: int = SEED
) -> DataFrame:
    """Expected value of every complete data row: mean and interval over all draws.

    Rows stay where they lie. Each task computes the draws from the fit and multiplies them with
    blocks of rows; of the row x draw table no more than a block ever exists.
    """
    design, posterior = fit.design, fit.posterior()
    ends = ((1 - width) / 2, (1 + width) / 2)
    schema = T.StructType([df.schema[c] for c in keep])
    for name in ("estimate", "est_error", "lower", "upper"):
        schema = schema.add(name, T.DoubleType())

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beta, _ = posterior.drawn(n, seed)
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                value = np.vstack(part["_x"].to_list()) @ beta.T
                lower, upper = np.quantile(value, ends, axis=1)
                yield pd.DataFrame({**{c: part[c] for c in keep}, "estimate": value.mean(axis=1), "est_error": value.std(axis=1, ddof=1), "lower": lower, "upper": upper})

    rows = design.complete_cases(df).select(*keep, F.array(*design.row()).alias("_x"))
    return spread_out(rows, fit.n).mapInPandas(summarize, schema)


#: Rows that meet all draws at a time; rows to a task.
BLOCK = 128
ROWS_PER_TASK = 10_000


def spread_out(rows: DataFrame, n: int) -> DataFrame:
    """Work on a row costs milliseconds while reading it costs nothing, so rows are
    spread evenly over tasks by their number ``n``, not by their bytes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(-(-n // ROWS_PER_TASK), min(cores, -(-n // BLOCK))))
