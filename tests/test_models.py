import numpy as np
import pytest
from pyspark.sql import functions as F

from reaction_norms.models import gaussian as M
from reaction_norms.models import loo as L
from reaction_norms.models.design import Design, design_for
from reaction_norms.models.numbers import normals_of, uniforms_of
from reaction_norms.operators import figures as G
from reaction_norms.operators import posterior as Q
from reaction_norms.operators import selection as S

POPS, YEARS = ("C1", "N1", "S1"), ("2010", "2017")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        p, y, x = POPS[i % 3], YEARS[i // 3 % 2], float(rng.normal())
        mean = 1.0 + 0.3 * (p == "N1") - 0.2 * (y == "2017") + (0.4 + 0.3 * (p == "S1")) * x
        rows.append((f"f{i}", p, int(y), x, x * x, float(mean + 0.3 * rng.normal())))
    rows += [("gap", "C1", 2010, None, None, 1.0), ("none", None, 2010, 0.1, 0.01, 1.0)]
    schema = "Dam_ID string, Population string, Year int, x double, x2 double, w double"
    return spark.createDataFrame(rows, schema).repartition(5)


def matrix(data, design):
    rows = design.complete_cases(data).orderBy("Dam_ID").select(*design.row(), design.response).collect()
    a = np.array([list(r) for r in rows])
    return a[:, :-1], a[:, -1]


def matrix_of(draws):
    """(beta, sigma) arrays of a draw table, by draw."""
    rows = draws.orderBy("draw").collect()
    return np.array([r.beta for r in rows]), np.array([r.sigma for r in rows])


def test_terms_of_the_three_model_forms():
    pops = tuple("abcdef")
    assert [len(Design("w", pops, YEARS, c).terms) for c in ((), ("x",), ("x", "x2"))] == [12, 18, 24]
    assert Design("w", POPS, YEARS, ("x",)).terms == (
        "Intercept", "PopulationN1", "PopulationS1", "Year2017", "x",
        "PopulationN1:Year2017", "PopulationS1:Year2017", "PopulationN1:x", "PopulationS1:x",
    )


def test_levels_come_sorted_from_the_data(data):
    design = design_for(data, "w", ["x"])
    assert (design.populations, design.years) == (POPS, YEARS)


@pytest.mark.parametrize("covariates", [(), ("x",), ("x", "x2")])
def test_least_squares_match_numpy(data, covariates):
    design = Design("w", POPS, YEARS, covariates)
    fit = M.fit_gaussian(data, design)
    x, y = matrix(data, design)
    beta, residual, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    got, s2 = fit.least_squares()
    assert fit.n == len(y) and rank == len(design.terms)
    assert got == pytest.approx(beta, abs=1e-10)
    assert s2 == pytest.approx(residual[0] / (len(y) - rank))


def test_draws_do_not_depend_on_partitions(spark, data):
    fit = M.fit_gaussian(data, Design("w", POPS, YEARS, ("x",)), M.SELECTION_PRIOR)
    by_draw = lambda df: {r.draw: (tuple(r.beta), r.sigma) for r in df.collect()}
    a = by_draw(fit.draws(spark, 50, partitions=8))
    assert a == by_draw(fit.draws(spark, 50, partitions=1)) and sorted(a) == list(range(1, 51))
    other = {r.draw: r.sigma for r in fit.draws(spark, 50, seed=7).collect()}
    assert other != {k: v[1] for k, v in a.items()}


def test_flat_draws_center_on_the_estimate(spark, data):
    fit = M.fit_gaussian(data, Design("w", POPS, YEARS, ("x",)))
    beta, sigma = matrix_of(fit.draws(spark, 4000))
    want, s2 = fit.least_squares()
    dof = fit.n - len(want)
    error = np.sqrt(np.diag(np.linalg.inv(fit.xtx)) * s2 * dof / (dof - 2))
    assert np.all(np.abs(beta.mean(axis=0) - want) < 4 * error / np.sqrt(4000))
    assert beta.std(axis=0, ddof=1) == pytest.approx(error, rel=0.06)
    assert (sigma**2).mean() == pytest.approx(s2 * dof / (dof - 2), rel=0.02)


def test_prior_draws_match_importance_weights(spark, data):
    """A strong prior on few rows: compare with reweighted flat-prior draws."""
    few = data.where(F.col("Dam_ID").isin(*[f"f{i}" for i in range(36)]))
    design = Design("w", POPS, YEARS, ("x",))
    prior = M.Prior(intercept_mean=0.8, intercept_sd=0.1, slope_mean=0.1, slope_sd=0.3, sigma_rate=5.0)
    beta, sigma = matrix_of(M.fit_gaussian(few, design, prior).draws(spark, 8000))
    flat = M.fit_gaussian(few, design)
    fb, fs = flat.posterior().sample(5, np.arange(60_000))
    alpha = fb @ flat.x_mean
    logw = -0.5 * ((alpha - 0.8) / 0.1) ** 2 - 0.5 * (((fb[:, 1:] - 0.1) / 0.3) ** 2).sum(axis=1)
    logw += -5.0 * fs + np.log(fs)  # the flat prior has density 1 / sigma
    w = np.exp(logw - logw.max())
    w /= w.sum()
    ess = 1 / (w**2).sum()
    assert ess > 500
    mean = w @ fb
    sd = np.sqrt(w @ (fb - mean) ** 2)
    assert np.all(np.abs(beta.mean(axis=0) - mean) < 5 * sd * np.sqrt(1 / ess + 1 / 8000))
    assert beta.std(axis=0) == pytest.approx(sd, rel=0.12)
    assert sigma.mean() == pytest.approx(w @ fs, rel=0.02)


PRIORS = [None, M.SELECTION_PRIOR, M.StudentPrior(0.9, 2.5), M.StudentPrior(0.0, 0.3)]


@pytest.mark.parametrize("prior", PRIORS, ids=["flat", "normal", "student", "narrow"])
def test_draws_as_columns_and_inside_tasks_are_the_same(spark, data, prior):
    posterior = M.fit_gaussian(data, Design("w", POPS, YEARS, ("x", "x2")), prior).posterior()
    beta, sigma = matrix_of(posterior.draws(spark, 300, seed=9))
    want_beta, want_sigma = posterior.sample(9, np.arange(1, 301))
    assert beta == pytest.approx(want_beta, abs=1e-9) and sigma == pytest.approx(want_sigma, abs=1e-9)
    # a draw does not depend on the draws beside it
    assert (posterior.sample(9, np.array([7, 250]))[0] == want_beta[[6, 249]]).all()


def test_numbers_are_uniform_normal_and_independent():
    u = uniforms_of(123, np.arange(1, 20_001), range(4))
    z = normals_of(u, 7)
    assert u.min() > 0 and u.max() < 1 and np.abs(u.mean(axis=0) - 0.5).max() < 0.01
    assert z.shape == (20_000, 7) and np.abs(z.mean(axis=0)).max() < 0.03 and np.abs(z.std(axis=0) - 1).max() < 0.02
    assert np.abs(np.corrcoef(z.T) - np.eye(7)).max() < 0.03
    assert (uniforms_of(124, np.arange(1, 5), range(4)) != u[:4]).all()


@pytest.mark.parametrize("prior", PRIORS[2:], ids=["wide", "narrow"])
def test_student_prior_agrees_with_numerical_integration(data, prior):
    few = data.where(F.col("Dam_ID").isin(*[f"f{i}" for i in range(48)]))
    fit = M.fit_gaussian(few, Design("w", POPS, YEARS), prior)
    posterior = fit.posterior()
    beta, sigma = posterior.sample(1, np.arange(40_000))
    mean = beta @ fit.x_mean
    flat, s2 = fit.least_squares()
    p, at = len(flat), fit.x_mean @ flat
    # the other coefficients integrate out
    a, s = np.linspace(at - 1.5, at + 1.5, 1501)[:, None], np.linspace(0.02, 2.0, 1500)[None, :]
    log = -(fit.n - p + 1) * np.log(s) - (fit.n - p) * s2 / (2 * s**2) - fit.n * (a - at) ** 2 / (2 * s**2)
    log += -(prior.dof + 1) / 2 * (np.log1p(((a - prior.location) / prior.scale) ** 2 / prior.dof) + np.log1p((s / prior.scale) ** 2 / prior.dof))
    w = np.exp(log - log.max())
    w /= w.sum()
    want_a, want_s = (w * a).sum(), (w * s).sum()
    sd_a, sd_s = np.sqrt((w * (a - want_a) ** 2).sum()), np.sqrt((w * (s - want_s) ** 2).sum())
    assert abs(mean.mean() - want_a) < 5 * sd_a / 200 and abs(sigma.mean() - want_s) < 5 * sd_s / 200
    assert mean.std() == pytest.approx(sd_a, rel=0.03) and sigma.std() == pytest.approx(sd_s, rel=0.05)
    if prior.scale < 1:
        assert abs(want_a - at) > 0.2 * sd_a  # the prior pulls


def test_default_prior_follows_median_and_deviation(spark):
    y = [1.04, 7.0, 100.0, 31.0, 12.5, -40.0]
    rows = [("C1", 2010, v) for v in y] + [("C1", 2010, None), ("zz", 2010, 5.0)]
    df = spark.createDataFrame(rows, "Population string, Year int, w double")
    prior = M.default_prior(df, Design("w", ("C1",), ("2010",)))
    middle = float(np.median(y))
    assert prior == M.StudentPrior(round(middle, 1), round(1.4826 * float(np.median(np.abs(np.array(y) - middle))), 1))
    narrow = spark.createDataFrame([("C1", 2010, 0.1 * i) for i in range(9)], "Population string, Year int, w double")
    assert M.default_prior(narrow, Design("w", ("C1",), ("2010",))).scale == 2.5
    far = M.fit_gaussian(narrow, Design("w", ("C1",), ("2010",)), M.StudentPrior(1e9, 1e-3))
    with pytest.raises(ValueError, match="far out"):
        far.posterior()


def test_wide_prior_agrees_with_least_squares(spark, data):
    design = Design("w", POPS, YEARS, ("x",))
    fit = M.fit_gaussian(data, design, M.Prior(0.0, 1e4, 0.0, 1e4, 1e-6))
    beta, _ = matrix_of(fit.draws(spark, 4000))
    want, s2 = M.fit_gaussian(data, design).least_squares()
    error = np.sqrt(np.diag(np.linalg.inv(fit.xtx)) * s2)
    assert np.all(np.abs(beta.mean(axis=0) - want) < 5 * error / np.sqrt(4000))


def test_expected_values_three_ways(spark, data):
    design = Design("w", POPS, YEARS, ("x",))
    draws = M.fit_gaussian(data, design).draws(spark, 20)
    beta, _ = matrix_of(draws)
    rows = design.complete_cases(data)
    fitted = M.fitted_values(data, M.fit_gaussian(data, design), ["Dam_ID"], n=20)
    x, _ = matrix(data, design)
    ids = [r.Dam_ID for r in rows.orderBy("Dam_ID").collect()]
    value = x @ beta.T
    columns = (value.mean(1), value.std(1, ddof=1), *np.quantile(value, (0.025, 0.975), axis=1))
    got = {r.Dam_ID: r[1:] for r in fitted.collect()}
    assert sorted(got) == sorted(ids)
    for i, *want in zip(ids, *columns):
        assert got[i] == pytest.approx(want)

    ranges = S.observed_range(rows, "x")
    effects = M.conditional_effects(draws, design, "x", ranges, n=5)
    bounds = {(r.Population, str(r.Year)): (r.lo, r.hi) for r in ranges.collect()}
    trend = {(r.draw, r.Population, r.Year): r.value for r in M.trend_draws(draws, design, "x").collect()}
    cell = {(r.draw, r.Population, r.Year): r.prediction for r in M.expected_cells(draws, design).collect()}
    seen = effects.collect()
    assert len(seen) == 20 * 6 * 5
    for r in seen:
        lo, hi = bounds[r.Population, r.Year]
        k = (r.draw, r.Population, r.Year)
        assert r.x == pytest.approx(lo + r.i * (hi - lo) / 4)
        assert r.value == pytest.approx(cell[k] + trend[k] * r.x)


def test_slopes_and_significance(spark, data):
    design = Design("w", POPS, YEARS, ("x",))
    draws = M.fit_gaussian(data, design, M.SELECTION_PRIOR).draws(spark, 1000)
    slopes = {r.Population: r for r in Q.slope_table(M.slope_draws(draws, design, "x"), "t").collect()}
    beta, _ = matrix_of(draws)
    at = list(design.terms).index
    s1 = beta[:, at("x")] + beta[:, at("PopulationS1:x")]
    assert slopes["S1"].linear_median == pytest.approx(np.median(s1))
    assert slopes["S1"].linear_lower == pytest.approx(np.quantile(s1, 0.025))
    assert slopes["C1"].linear_upper == pytest.approx(np.quantile(beta[:, at("x")], 0.975))
    probs = Q.slope_probability(M.trend_draws(draws, design, "x"))
    effects = Q.join_significance(
        M.conditional_effects(draws, design, "x", S.observed_range(data, "x"), n=3), probs
    )
    assert {r.sig for r in effects.select("sig").distinct().collect()} == {"Significant"}
    assert G.ribbon(effects, "x").count() == 6 * 3
    summary = {r.term: r for r in Q.coefficient_summary(draws, design.terms).collect()}
    assert set(summary) == {*design.terms, "sigma"}
    assert summary["x"].estimate == pytest.approx(beta[:, at("x")].mean())
    kept = Q.subsample_draws(draws, 100)
    assert kept.count() == 100
    assert {r.draw for r in kept.collect()} == {r.draw for r in Q.subsample_draws(draws.repartition(3), 100).collect()}


def exact_loo(x, y):
    """Log predictive density of each left-out row under the flat prior."""
    from math import lgamma

    n, p = x.shape
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    left = e / (1 - h)
    s2 = ((e @ e) - e**2 / (1 - h)) / (n - 1 - p)
    scale2, v = s2 / (1 - h), n - 1 - p
    const = lgamma((v + 1) / 2) - lgamma(v / 2)
    return const - 0.5 * np.log(np.pi * v * scale2) - (v + 1) / 2 * np.log1p(left**2 / (v * scale2))


def test_scores_match_exact_leave_one_out(spark, data):
    models, exact = {}, {}
    for name, covariates in (("flat", ()), ("linear", ("x",)), ("quadratic", ("x", "x2"))):
        design = Design("w", POPS, YEARS, covariates)
        fit = M.fit_gaussian(data.where("x is not null"), design)
        models[name] = fit
        exact[name] = exact_loo(*matrix(data.where("x is not null"), design))
    pointwise = L.loo_pointwise(data, models, ["Dam_ID"])
    # the row without x is complete for the model that does not need it
    assert [r.Dam_ID for r in pointwise.where("elpd_linear is null").collect()] == ["gap"]
    rows = pointwise.where("elpd_linear is not null").orderBy("Dam_ID").collect()
    for name in models:
        got = np.array([r[f"elpd_{name}"] for r in rows])
        k = np.array([r[f"pareto_k_{name}"] for r in rows])
        error = np.abs(got - exact[name])
        assert error[k < 0.3].max() < 0.05 and (k < 0.3).mean() > 0.8
        assert error.max() < 0.25
        assert abs(got.sum() - exact[name].sum()) < 0.4
        # the greatest shape of all rows is a chance figure of the draws: several sets of them
        x, y = matrix(data.where("x is not null"), models[name].design)
        drawn = [models[name].posterior().sample(seed, np.arange(1, 8001)) for seed in range(1, 6)]
        assert np.median([L.score_rows(x, y, *d)[2].max() for d in drawn]) < 0.7
    table = L.loo_compare(pointwise, {"t": list(models)}).collect()
    assert {r.trait for r in table} == {"t"}
    assert table[0].elpd_diff == 0 and table[0].se_diff == 0
    assert table[0].model in ("linear", "quadratic") and table[2].model == "flat"
    best = exact[table[0].model]
    diff = exact["flat"] - best
    assert table[2].elpd_diff == pytest.approx(diff.sum(), abs=0.5)
    assert table[2].se_diff == pytest.approx(np.sqrt(len(diff) * diff.var(ddof=1)), rel=0.02)
    scores = {r.model: r for r in L.loo_scores(pointwise, list(models)).collect()}
    assert scores["linear"].looic == pytest.approx(-2 * scores["linear"].elpd_loo)
    assert 5 < scores["linear"].p_loo < 15


@np.errstate(all="ignore")
def plain_scores(x, y, beta, sigma):
    """(elpd, lpd, tail shape) of one row, step by step."""
    ll = -0.5 * ((y - beta @ x) / sigma) ** 2 - np.log(sigma) - 0.5 * np.log(2 * np.pi)
    lse = lambda v: v.max() + np.log(np.exp(v - v.max()).sum())
    s = len(ll)
    order, lw = np.argsort(-ll, kind="stable"), ll.min() - ll
    n = int(np.ceil(min(0.2 * s, 3 * np.sqrt(s))))
    floor = np.exp(max(lw[order[s - n - 1]], np.log(np.finfo(float).tiny)))
    e = np.exp(lw[order[s - n :]]) - floor
    m = 30 + int(np.sqrt(n))
    theta = np.array([1 / e[-1] + (1 - np.sqrt(m / (j - 0.5))) / (3 * e[int(n / 4 + 0.5) - 1]) for j in range(1, m + 1)])
    k = np.array([np.log1p(-t * e).mean() for t in theta])
    weight = n * (np.log(-theta / k) - k - 1)
    best = (theta * np.exp(weight - lse(weight))).sum()
    k = np.log1p(-best * e).mean()
    scale, k = -k / best, (k * n + 5) / (n + 10)
    p = (np.arange(1, n + 1) - 0.5) / n
    smooth = np.log(scale * np.expm1(-k * np.log1p(-p)) / k + floor)
    if np.isfinite(k) and np.isfinite(smooth).all():
        lw[order[s - n :]] = np.minimum(smooth, 0)
    else:
        k = np.inf
    return lse(lw + ll) - lse(lw), lse(ll) - np.log(s), k


def test_rows_are_scored_in_little_memory_as_one_by_one(data):
    """However many rows come at once, few meet the draws at a time; their neighbours do not matter."""
    import tracemalloc

    design = Design("w", POPS, YEARS, ("x", "x2"))
    x, y = matrix(data.where("x is not null"), design)
    drawer = M.fit_gaussian(data.where("x is not null"), design).posterior()
    beta, sigma = drawer.sample(5, np.arange(1, 8001))
    x, y = np.tile(x, (3, 1)), np.tile(y, 3)
    # far from every draw: likelihoods beyond the range of a double
    y[:3] += [10, 60, -300]
    tracemalloc.start()
    together = np.array(L.score_rows(x, y, beta, sigma))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(y) > 500 and peak < len(y) * len(sigma) * 8 / 2
    for i in [0, 1, 2, *range(3, len(y), 40)]:
        assert together[:, i] == pytest.approx(np.array(L.score_rows(x[i : i + 1], y[i : i + 1], beta, sigma))[:, 0], rel=1e-9)
        assert together[:, i] == pytest.approx(plain_scores(x[i], y[i], beta, sigma), rel=1e-8), i


@pytest.mark.parametrize("spread", [0.0001, 0.001, 0.005, 0.02, 0.2, 1.0])
def test_scores_of_near_and_far_draws_match_the_plain_ones(spread):
    """Sums by powers of log weights, by exponentials and in logarithms."""
    rng = np.random.default_rng(11)
    beta, sigma = np.array([1.0, -0.5, 0.0]) + rng.normal(0, spread, (8000, 3)), np.exp(rng.normal(0, spread / 10, 8000))
    x = np.column_stack([np.ones(70), rng.normal(size=70), np.repeat([0.0, 1.0], 35)])
    y = x @ [1.0, -0.5, 0.0] + rng.normal(size=70)
    got = L.score_rows(x, y, beta, sigma)
    for i in range(70):
        assert got[:, i] == pytest.approx(plain_scores(x[i], y[i], beta, sigma), rel=1e-8, abs=1e-10), i


def test_equal_draws_are_not_smoothed():
    got = L.score_rows(np.ones((3, 1)), np.array([0.0, 1.0, 5.0]), np.full((8000, 1), 0.5), np.full(8000, 2.0))
    want = -0.5 * (np.array([-0.5, 0.5, 4.5]) / 2) ** 2 - np.log(2) - 0.5 * np.log(2 * np.pi)
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want) and np.isinf(got[2]).all()


def test_few_exponentials_and_logarithms_a_row(monkeypatch):
    """The draws of a model of many rows lie close together: only the tail of a row needs them."""

    class Counted:
        taken = 0

        def __getattr__(self, name):
            fn = getattr(np, name)
            if name not in ("exp", "log", "log1p", "expm1"):
                return fn

            def counted(a, *args, **kwargs):
                Counted.taken += np.size(a)
                return fn(a, *args, **kwargs)

            return counted

    rng = np.random.default_rng(12)
    beta, sigma = rng.normal(0, 0.002, (8000, 2)), np.exp(rng.normal(0, 0.001, 8000))
    x, y = np.column_stack([np.ones(200), rng.normal(size=200)]), rng.normal(size=200)
    monkeypatch.setattr(L, "np", Counted())
    L.score_rows(x, y, beta, sigma)
    assert 0 < Counted.taken / 200 < 2_500


def test_design_rows_in_tasks(data):
    design = Design("w", POPS, YEARS, ("x", "x2"))
    rows = design.complete_cases(data).select("*", F.array(*design.row()).alias("row")).toPandas()
    values = {c: rows[c].to_numpy() for c in ("x", "x2")}
    got = design.matrix(rows["Population"].to_numpy(), rows["Year"].astype(str).to_numpy(), values)
    assert len(got) > 100 and np.array_equal(got, np.vstack(rows["row"].to_list()))


def test_rows_complete_for_some_models_only(spark):
    rng = np.random.default_rng(3)
    rows = [(f"f{i}", POPS[i % 3], 2010 + 7 * (i // 3 % 2), float(rng.normal()), None if i % 5 == 0 else float(rng.normal()), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "Dam_ID string, Population string, Year int, x double, x2 double, w double")
    fits = {name: M.fit_gaussian(df, Design("w", POPS, YEARS, c)) for name, c in (("one", ("x",)), ("two", ("x2",)))}
    both = {r.Dam_ID: r for r in L.loo_pointwise(df, fits, ["Dam_ID"], n=400).collect()}
    alone = {r.Dam_ID: r for r in L.loo_pointwise(df, {"two": fits["two"]}, ["Dam_ID"], n=400).collect()}
    assert len(both) == 120 and len(alone) == 96
    for i, r in both.items():
        assert (r.elpd_two is None) == (i not in alone) and r.elpd_one is not None
        assert i not in alone or r.elpd_two == pytest.approx(alone[i].elpd_two)
    got = {r.model: r for r in L.loo_scores(L.loo_pointwise(df, fits, n=400), list(fits)).collect()}
    values = np.array([r.elpd_two for r in alone.values()])
    assert got["two"].elpd_loo == pytest.approx(values.sum()) and got["two"].se_elpd_loo == pytest.approx(np.sqrt(96 * values.var(ddof=1)))


def test_too_few_rows_are_refused(data):
    design = Design("w", POPS, YEARS, ("x", "x2"))
    with pytest.raises(ValueError, match="flat prior"):
        M.fit_gaussian(data.where("Dam_ID in ('f1', 'f2', 'f3')"), design).least_squares()
    with pytest.raises(ValueError, match="no complete rows"):
        M.fit_gaussian(data.where("w is null"), design)


def test_task_code_travels_without_the_package(data, tmp_path):
    """Executors need not have the package: its task functions are pickled by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    fit = M.fit_gaussian(data, Design("w", POPS, YEARS, ("x",)), M.SELECTION_PRIOR)
    flat = M.fit_gaussian(data, Design("w", POPS, YEARS, ("x",)))
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((fit.posterior().drawn, flat.posterior().sample, L.score_rows)))
    code = (
        "import pickle, numpy as np, sys\n"
        "a, b, score = pickle.load(open('f.pkl', 'rb'))\n"
        "beta, sigma = a(200, 1); b(1, np.arange(3))\n"
        "print(len(score(np.ones((2, 9)), np.ones(2), beta, sigma)[0]), 'reaction_norms' in sys.modules)\n"
    )
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60
    )
    assert out.stdout.split() == ["2", "False"], out.stderr
