"""Leave-one-out scores by Pareto-smoothed importance sampling, and model comparison.

Each data row needs its own weights over all draws but nothing from other rows, so
rows are scored where they lie, in Arrow batches, against the draws (a fixed number).
The row x draw table is never stored. References: Vehtari, Gelman & Gabry (2017);
Zhang & Stephens (2009).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reaction_norms.models.gaussian import N_DRAWS, SEED, GaussianFit, spread_out

#: Rows that meet all draws at a time; their tables stay in a processor's own cache.
ROWS = 8
#: Rows whose tails are smoothed at a time.
TAILS = 32
#: Factors that become one polynomial, and polynomials whose product goes into one logarithm.
FACTORS = 8
JOINED = 4
#: Half ranges of log weights up to which sums of powers to the fourth, sixth and eighth give the sums of
#: exponentials: what is left out of them is below 2e-13 of a term.
SHORT = ((4, 0.005), (6, 0.05), (8, 0.15))
#: Range of a row's log weights up to which no weight nears the ends of a double's range.
PLAIN = 500.0


def _logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=1)) + top[:, 0]


def _products(x: np.ndarray) -> np.ndarray:
    """Coefficients of ``prod((1 - x) + t x)`` over every ``FACTORS`` values, by powers of t; none is negative.

    A last few products are of fewer values or 1, so that their number is a multiple of ``JOINED``.
    """
    rows, n = x.shape
    width = -(-n // (FACTORS * JOINED)) * JOINED
    at_one = np.zeros((rows, FACTORS * width))
    at_one[:, :n] = x
    at_one = at_one.reshape(rows, FACTORS, width)
    at_zero = 1.0 - at_one
    out = np.zeros((FACTORS + 1, rows, width))
    out[0] = 1.0
    for i in range(FACTORS):
        raised = out[: i + 1] * at_one[:, i]
        out[: i + 1] *= at_zero[:, i]
        out[1 : i + 2] += raised
    return out


def _mean_log(tau: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean of ``log(1 - (1 - tau) x)`` over x, from 0 to 1, per row and tau: logarithms of products."""
    n = x.shape[1]
    powers = np.ones((FACTORS + 1, *tau.shape))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for k in range(FACTORS):
            np.multiply(powers[k], tau, out=powers[k + 1])
        product = np.matmul(_products(x).transpose(1, 2, 0), powers.transpose(1, 0, 2))
        product = product.reshape(len(x), JOINED, -1, tau.shape[1]).prod(axis=1)
        mean = np.log(product, out=product).sum(axis=1) / n
    far = ~np.isfinite(mean).all(axis=1)  # a product beyond the range of a double
    if far.any():
        mean[far] = np.log1p((tau[far] - 1.0)[:, :, None] * x[far][:, None, :]).mean(axis=2)
    return mean


def _pareto_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Generalised-Pareto (k, sigma) per row of ascending positive exceedances."""
    n = x.shape[1]
    m = 30 + int(np.sqrt(n))
    j = np.arange(1, m + 1)
    top, quarter = x[:, -1:], x[:, int(n / 4 + 0.5) - 1][:, None]
    # in units of the greatest: theta = 1 - tau
    x = x / top
    tau = (np.sqrt(m / (j - 0.5)) - 1.0) * (top / (3.0 * quarter))
    theta = 1.0 - tau
    k = _mean_log(tau, x)
    loglik = n * (np.log(-theta / k) - k - 1.0)
    weight = np.exp(loglik - _logsumexp(loglik)[:, None])
    best = (theta * weight).sum(axis=1)
    shape = np.log1p(-best[:, None] * x).mean(axis=1)
    scale = -shape / best * top[:, 0]
    return (shape * n + 5.0) / (n + 10.0), scale


def _smooth_weights(lw: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed weights and tail shape k of each row.

    ``lw`` has the cut and then the tail of the log weights, ascending to 0, and ``raw`` the weights of the tail.
    """
    out, k = raw.copy(), np.full(len(raw), np.inf)
    tail = raw.shape[1]
    if not tail:
        return out, k
    # A flat tail (all equal) needs no smoothing.
    varied = (lw[:, -1] - lw[:, 1] > np.finfo(float).eps * 100) & (lw[:, 1] > lw[:, 0])
    if varied.any():
        floor = np.exp(lw[varied, 0])[:, None]
        shape, scale = _pareto_fit(raw[varied] - floor)
        p = (np.arange(1, tail + 1) - 0.5) / tail
        step = np.expm1(-shape[:, None] * np.log1p(-p)) / shape[:, None]
        smooth = scale[:, None] * step + floor
        good = np.isfinite(shape) & (np.isfinite(smooth) & (smooth > 0.0)).all(axis=1)
        out[varied] = np.where(good[:, None], np.minimum(smooth, 1.0), out[varied])
        k[varied] = np.where(good, shape, np.inf)
    return out, k


def smooth_tail(lw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest log weights of each row: (values, smoothed values, tail shape k), ascending.

    ``lw`` has a row maximum of 0. Only the tail changes, so callers keep the rest.
    """
    rows, s = lw.shape
    k = np.full(rows, np.inf)
    tail = int(np.ceil(min(0.2 * s, 3.0 * np.sqrt(s))))
    if tail < 5:
        return np.empty((rows, 0)), np.empty((rows, 0)), k
    ranked = np.partition(lw, s - tail - 1, axis=1)[:, s - tail - 1 :]
    ranked.sort(axis=1)
    ranked[:, 0] = np.maximum(ranked[:, 0], np.log(np.finfo(float).tiny))
    raw = ranked[:, 1:]
    smoothed, k = _smooth_weights(ranked, np.exp(raw))
    with np.errstate(divide="ignore"):
        return raw, np.where(np.isfinite(k)[:, None], np.log(smoothed), raw), k


def _score_wide(lw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows whose weights may lie beyond the range of a double, from their log weights.

    Outside the tail a weight is the inverse likelihood, so weight times likelihood is
    constant there, and the likelihoods are the weights' inverses: one pass of ``exp`` serves both.
    """
    s = lw.shape[1]
    high = lw.max(axis=1)
    lw = np.sort(lw - high[:, None], axis=1)
    raw, smoothed, k = smooth_tail(lw)
    weight = np.exp(lw)
    total = weight[:, : s - raw.shape[1]].sum(axis=1) + np.exp(smoothed).sum(axis=1)
    # In units of the lowest likelihood of the row.
    weighted = (s - raw.shape[1]) + np.exp(smoothed - raw).sum(axis=1)
    with np.errstate(divide="ignore", over="ignore"):
        lpd = np.log(np.divide(1.0, weight, out=weight).sum(axis=1))
    far = ~np.isfinite(lpd)  # a likelihood beyond the range of a double
    if far.any():
        lpd[far] = _logsumexp(-lw[far])
    low = -high - 0.5 * np.log(2 * np.pi)
    return np.log(weighted) + low - np.log(total), lpd + low - np.log(s), k


def _sums_of_exp(u: np.ndarray, half: float, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row sums of ``exp(u)`` and ``exp(-u)``, where no u is beyond ``half``; ``u`` may be overwritten."""
    degree = next((d for d, most in SHORT if half <= most), None)
    if degree is None:
        e = np.exp(u, out=u)
        return e.sum(axis=1), np.divide(1.0, e, out=e).sum(axis=1)
    odd, even, factorial = u.sum(axis=1), u.shape[1] + np.vecdot(u, u) / 2.0, 2.0
    power = u
    for k in range(2, degree // 2 + 1):
        raised = np.multiply(power, u, out=space[k % 2, : len(u), : u.shape[1]])
        factorial *= 2 * k - 1
        odd += np.vecdot(power, raised) / factorial
        factorial *= 2 * k
        even += np.vecdot(raised, raised) / factorial
        power = raised
    return even + odd, even - odd


def _score_block(rows: np.ndarray, weights: np.ndarray, log_sigma: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Scores of a few rows; ``rows @ weights`` are their residuals, in units of ``sqrt(2) * sigma``, under every draw.

    Weights and likelihoods, their inverses, outside the tail are summed about the middle of a row's log
    weights; then only the tail of each row is left to smooth.
    """
    n, s = len(rows), len(log_sigma)
    tail = int(np.ceil(min(0.2 * s, 3.0 * np.sqrt(s))))
    tail = 0 if tail < 5 else tail
    ends, mid, weight, likelihood = np.empty((n, tail + 1)), np.empty(n), np.empty(n), np.empty(n)
    out, wide = np.full((3, n), np.inf), np.zeros(n, bool)
    for start in range(0, n, ROWS):
        at = slice(start, start + ROWS)
        lw = np.matmul(rows[at], weights, out=space[2, : len(rows[at])])
        np.multiply(lw, lw, out=lw)
        lw += log_sigma
        lw.partition(s - tail - 1, axis=1)
        ends[at] = lw[:, s - tail - 1 :]
        low, high = lw[:, : s - tail].min(axis=1), ends[at].max(axis=1)
        wide[at] = ~(high - low <= PLAIN)
        if wide[at].any():
            out[:, at][:, wide[at]] = _score_wide(lw[wide[at]])
            lw[wide[at]], low[wide[at]], high[wide[at]] = 0.0, 0.0, 0.0
        mid[at] = (low + high) / 2.0
        lw -= mid[at][:, None]
        weight[at], likelihood[at] = _sums_of_exp(lw[:, : s - tail], float((high - low).max()) / 2.0, space)
    plain = ~wide
    if not plain.any():
        return out
    ends, mid = ends[plain], mid[plain]
    high = ends.max(axis=1)
    lw = np.sort(ends, axis=1) - high[:, None]
    raw = np.exp(lw[:, 1:])
    smoothed, k = _smooth_weights(lw, raw)
    total = weight[plain] * np.exp(mid - high) + smoothed.sum(axis=1)
    weighted = (s - tail) + (smoothed / raw).sum(axis=1)
    likely = likelihood[plain] + np.exp(mid - high) * (1.0 / raw).sum(axis=1)
    out[:, plain] = np.log(weighted) - high - np.log(total), np.log(likely / s) - mid, k
    out[:2, plain] -= 0.5 * np.log(2 * np.pi)
    return out


def score_rows(x: np.ndarray, y: np.ndarray, beta: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """(elpd, in-sample lpd, tail shape) of each row.

    Rows of one cell are zero in the same columns; they are scored together, without these. Rows
    that lie about as far from the draws have log weights of about the same range.
    """
    unit = np.sqrt(2.0) * sigma
    scaled, log_sigma = -(beta / unit[:, None]).T, np.log(sigma)
    kinds, kind = np.unique(x != 0, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    out, space = np.empty((3, len(y))), np.empty((3, ROWS, len(sigma)))
    for number, used in enumerate(kinds):
        mine = np.flatnonzero(kind == number)
        rows, weights = np.column_stack([y[mine], x[np.ix_(mine, used)]]), np.vstack([1.0 / unit, scaled[used]])
        away = np.argsort(np.abs(rows @ weights.mean(axis=1)), kind="stable")
        mine, rows = mine[away], rows[away]
        for start in range(0, len(mine), TAILS):
            out[:, mine[start : start + TAILS]] = _score_block(rows[start : start + TAILS], weights, log_sigma, space)
    return out


def loo_pointwise(
    df: DataFrame, models: Mapping[str, GaussianFit], keep: Sequence[str] = (), n: int = N_DRAWS, seed: int = SEED
) -> DataFrame:
    """Per data row and model: ``elpd_<m>``, ``lpd_<m>``, ``pareto_k_<m>``.

    All models are scored in the same pass, so comparing them needs no join. A row that is
    complete for some models only has nulls for the others; rows complete for none are left out. Each task
    computes the draws from the fits, small matrices, so no draws are shipped.
    """
    designs = {name: fit.design for name, fit in models.items()}
    drawers = {name: fit.posterior() for name, fit in models.items()}
    whole = {name: design.is_complete() for name, design in designs.items()}
    measured = dict.fromkeys(c for d in designs.values() for c in (*d.covariates, d.response))
    columns = [F.col(c).cast("string").alias(f"_{c}") for c in ("Population", "Year")]
    columns += [F.col(c).cast("double").alias(f"_v_{c}") for c in measured]
    columns += [complete.alias(f"_whole_{name}") for name, complete in whole.items()]
    schema = T.StructType([df.schema[c] for c in keep])
    for name in models:
        for part in ("elpd", "lpd", "pareto_k"):
            schema = schema.add(f"{part}_{name}", T.DoubleType())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: batch[c] for c in keep}
            for name, drawer in drawers.items():
                at, design = (batch[f"_whole_{name}"] == True).to_numpy(), designs[name]  # noqa: E712
                scores = np.full((3, len(batch)), np.nan)
                if at.any():
                    mine = batch[at]
                    values = {c: mine[f"_v_{c}"].to_numpy() for c in (*design.covariates, design.response)}
                    x = design.matrix(mine["_Population"].to_numpy(), mine["_Year"].to_numpy(), values)
                    scores[:, at] = score_rows(x, values[design.response], *drawer.drawn(n, seed))
                for label, values in zip(("elpd", "lpd", "pareto_k"), scores):
                    out[f"{label}_{name}"] = pd.Series(values, batch.index).astype(object).where(at, None)
            yield pd.DataFrame(out)

    rows = df.where(reduce(lambda a, b: a | b, whole.values())).select(*keep, *columns)
    return spread_out(rows, max(fit.n for fit in models.values())).mapInPandas(score, schema)


def _sum_se(col) -> tuple:
    return F.sum(col), F.sqrt(F.count(col) * F.var_samp(col))


def _score_rows(pointwise: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per model with its scores and its differences ``vs`` to every model of its group, over
    the rows that are complete for all models of the group.

    A single aggregate over the pointwise table, which is costly to compute twice.
    """
    rows = []
    for place, (group, models) in enumerate(groups.items()):
        whole = reduce(lambda a, b: a & b, [F.col(f"elpd_{m}").isNotNull() for m in models])
        for m in models:
            elpd, lpd = (F.when(whole, F.col(f"{part}_{m}")) for part in ("elpd", "lpd"))
            elpd_sum, elpd_se = _sum_se(elpd)
            p_sum, p_se = _sum_se(lpd - elpd)
            against = []
            for b in models:
                diff, diff_se = _sum_se(elpd - F.col(f"elpd_{b}"))
                against.append(F.struct(F.lit(b).alias("best"), diff.alias("elpd_diff"), diff_se.alias("se_diff")))
            rows.append(
                F.struct(
                    F.lit(place).alias("_place"),
                    F.lit(group).alias("_group"),
                    F.lit(m).alias("model"),
                    elpd_sum.alias("elpd_loo"),
                    elpd_se.alias("se_elpd_loo"),
                    p_sum.alias("p_loo"),
                    p_se.alias("se_p_loo"),
                    (-2 * elpd_sum).alias("looic"),
                    (2 * elpd_se).alias("se_looic"),
                    F.count_if(whole & (F.col(f"pareto_k_{m}") > 0.7)).alias("n_high_k"),
                    F.array(*against).alias("vs"),
                )
            )
    return pointwise.agg(F.array(*rows).alias("r")).select("r", F.inline("r"))


def loo_scores(pointwise: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per model: elpd, effective parameters, information criterion, errors."""
    return _score_rows(pointwise, {"": models}).drop("r", "_place", "_group", "vs")


def loo_compare(pointwise: DataFrame, groups: Mapping[str, Sequence[str]], name: str = "trait") -> DataFrame:
    """Scores with the difference to the best model of its group and its error, groups in order, best first."""
    mine = F.filter("r", lambda x: x["_group"] == F.col("_group"))
    best = F.array_max(F.transform(mine, lambda x: F.struct(x["elpd_loo"], x["model"])))["model"]
    versus = F.filter("vs", lambda v: v["best"] == F.col("_best"))[0]
    return (
        _score_rows(pointwise, groups)
        .withColumn("_best", best)
        .select("*", versus["elpd_diff"].alias("elpd_diff"), versus["se_diff"].alias("se_diff"), F.col("_group").alias(name))
        .orderBy("_place", F.col("elpd_diff").desc(), "model")
        .drop("r", "_place", "_group", "_best", "vs")
    )
