import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reaction_norms.functions import columns as C
from reaction_norms.functions import lookup
from reaction_norms.functions.quantiles import draw_quantiles, exact_quantiles
from reaction_norms.operators import climate as K
from reaction_norms.operators import figures as G
from reaction_norms.operators import reshape as R


def one(spark, rows, schema, *cols):
    return tuple(spark.createDataFrame(rows, schema).agg(*cols).first())


def test_mean_propagates_or_skips_missing(spark):
    rows = [(1.0,), (3.0,), (None,)]
    assert one(spark, rows, "v double", C.mean("v"), C.mean("v", na_rm=True)) == (None, 2.0)


def test_variation_of_one_row_or_zero_mean_is_missing(spark):
    assert one(spark, [(4.0,)], "v double", C.coefficient_of_variation("v")) == (None,)
    assert one(spark, [(-1.0,), (1.0,)], "v double", C.coefficient_of_variation("v")) == (None,)


def test_zeros_count_on_neither_side(spark):
    got = one(spark, [(0.0,), (0.0,), (1.0,), (-1.0,)], "v double", *C.probability_of_difference("v"))
    assert got == (0.25, 0.25, 0.25)


def test_labels_stars_levels(spark):
    df = spark.createDataFrame(
        [("N1", 0.999), ("C2", 0.996), ("S1", 0.95), ("X", 0.545), (None, 1.0)], "p string, v double"
    )
    rows = df.select(
        C.stars("v"),
        C.pd_label("v"),
        C.with_level("p", ["S1", "C2", "N1"]),
        C.level_rank("p", ["S1", "C2", "N1"]),
        C.censor("v", 0.95, 0.999),
        C.key_text("p", F.lit(2010)),
    ).collect()
    assert [r[0] for r in rows] == ["***", "**", "*", "", "***"]
    assert [r[1].removeprefix("PD(≠0) = ") for r in rows] == ["1", "1", "0.95", "0.54", "1"]
    assert [r[2] for r in rows] == ["N1", "C2", "S1", None, None]
    assert [r[3] for r in rows] == [3, 2, 1, None, None]
    assert [r[4] for r in rows] == [0.999, 0.996, 0.95, None, None]
    assert rows[4][5] == "NA-2010"
    order = df.orderBy(*C.relevel_order("p", ["S1"])).collect()
    assert [r.p for r in order] == ["S1", "C2", "N1", "X", None]


def test_with_levels_answers_any_number_of_levels(spark):
    stats = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    stats = stats.unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    rows = spark.range(20_010).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit(1).alias("v_old"))
    got = lookup.with_levels(rows, stats, ["k"], ["v"])
    assert got.columns == ["k", "v_old", "v"]
    found = {r.k: r.v for r in got.collect()}
    assert len(found) == 20_010 and found[None] == -1 and found[19_999] == 39_998 and found[20_009] is None


def test_level_cells_over_several_blocks(spark, monkeypatch):
    from reaction_norms.operators import reshape

    monkeypatch.setattr(reshape, "LEVELS_PER_BLOCK", 3)
    df = spark.range(40).select((F.col("id") % 4).alias("a"), F.when(F.col("id") > 0, F.col("id")).alias("b"))
    got = [tuple(r) for r in reshape.level_cells(df, ["a", "b"]).collect()]
    assert sorted(got) == [(a, b) for a in range(4) for b in range(1, 40)]
    assert reshape.level_cells(df.where("b is null"), ["a", "b"]).count() == 0


def test_draw_quantiles_of_many_draws(spark):
    got = draw_quantiles(spark.range(150_001).withColumnRenamed("id", "v"), "v", {"m": 0.5}, []).first()
    assert got.m == 75_000


@pytest.mark.parametrize("shape", ["normal", "third_equal", "outliers", "small"])
def test_exact_quantiles_match_numpy(spark, shape):
    rng = np.random.default_rng(3)
    n = 37 if shape == "small" else 60_000
    v = rng.normal(size=n)
    if shape == "third_equal":
        v[: n // 3] = 0.25
    if shape == "outliers":
        v[:50] *= 1e9
    g = np.array(["a", "b"])[(rng.random(n) < 0.3).astype(int)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(6)
    probs = {"p0": 0.0, "p01": 0.0003, "q1": 0.25, "m": 0.5, "q3": 0.75, "p1": 1.0}
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(v[g == r.g], p), rel=1e-12, abs=1e-12)
    whole = exact_quantiles(df, "v", {"m": 0.5}, []).first()
    assert whole.m == pytest.approx(np.quantile(v, 0.5))
    small = draw_quantiles(df, "v", {"m": 0.4}, ["g"]).collect()
    assert {r.g: r.m for r in small} == pytest.approx({k: np.quantile(v[g == k], 0.4) for k in "ab"})


@pytest.mark.parametrize("shape", ["heavy_tail", "two_thirds_equal", "infinite"])
def test_brackets_are_narrowed_until_they_are_small(spark, monkeypatch, shape):
    """Every rank is found, whatever a poor sketch says."""
    from reaction_norms.functions import quantiles as Z

    monkeypatch.setattr(Z, "LIMIT", 400)
    monkeypatch.setattr(Z, "ACCURACY", 1_000)  # a poor sketch
    rounds = []
    narrowed = Z._narrowed
    monkeypatch.setattr(Z, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    rng = np.random.default_rng(8)
    n = 20_000
    v = rng.normal(size=n)
    if shape == "heavy_tail":
        v = np.sign(v) * np.exp(60 * np.abs(v))
    if shape == "two_thirds_equal":
        v[: 2 * n // 3] = 0.5
    if shape == "infinite":
        v[:3000], v[3000:9000] = -np.inf, np.inf
    g = np.where(rng.random(n) < 0.01, "b", "a")
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(5)
    probs = {"p0": 0.0, "q1": 0.25, "m": 0.5, "p99": 0.9995}
    for r in Z.exact_quantiles(df, "v", probs, ["g"]).collect():
        mine = np.sort(v[g == r.g])
        for name, p in probs.items():
            h = (len(mine) - 1) * p
            low, high = mine[int(np.floor(h))], mine[int(np.ceil(h))]
            want = low if low == high else low + (h - np.floor(h)) * (high - low)
            assert r[name] == pytest.approx(want, rel=1e-12, abs=1e-12), (r.g, name)
    assert 1 <= len(rounds) <= 8


def test_open_brackets_hold_no_more_than_the_limit(spark, monkeypatch):
    from reaction_norms.functions import quantiles as Z

    monkeypatch.setattr(Z, "LIMIT", 500)
    states = []
    kept = Z.materialize
    monkeypatch.setattr(Z, "materialize", lambda df: states.append(kept(df)) or states[-1])
    df = spark.range(200_000).select(F.lit("one").alias("g"), F.rand(4).alias("v"))
    Z.exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}, ["g"]).collect()
    assert Z._widest(states[0]) == 200_000 and 0 < Z._widest(states[-1]) <= 500


def test_limits_drop_values_before_intervals_and_densities(spark):
    df = spark.createDataFrame([("k", float(x)) for x in range(101)], "g string, v double")
    r = {x.width: x for x in G.interval_summary(df, "v", ["g"], widths=(0.5,), limits=(0, 50)).collect()}[0.5]
    assert (r.median, r.lower, r.upper) == (25.0, 12.5, 37.5)
    cut = G.density_curve(df, "v", ["g"], n=16, limits=(0, 50)).collect()
    alone = G.density_curve(df.where("v <= 50"), "v", ["g"], n=16).collect()
    assert cut == alone and max(r.x for r in cut) == 50


def test_box_summary_matches_numpy(spark):
    rnd = random.Random(1)
    values = [rnd.gauss(0, 1) for _ in range(200)] + [9.0, -8.0, 50.0]
    df = spark.createDataFrame([("k", v) for v in values], "g string, v double")
    r = G.box_summary(df, "v", ["g"], limits=(-10, 10)).first()
    v = np.array([x for x in values if -10 <= x <= 10])
    q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    want = (inside.min(), q1, m, q3, inside.max(), len(v), len(v) - len(inside))
    assert tuple(r)[1:] == pytest.approx(want)


def test_binned_density_is_close_to_direct(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=3000)], "v double")
    direct = {r.i: r.density for r in G.density_curve(df, "v", n=64).collect()}
    binned = {r.i: r.density for r in G.density_curve(df, "v", n=64, bins=1024).collect()}
    assert direct.keys() == binned.keys()
    assert max(abs(direct[i] - binned[i]) for i in direct) < 1e-4
    x = {r.i: r.x for r in G.density_curve(df, "v", n=64).collect()}
    area = np.trapezoid([direct[i] for i in sorted(x)], [x[i] for i in sorted(x)])
    assert area == pytest.approx(1.0, abs=0.02)


def test_contrast_plans_agree(spark):
    rnd = random.Random(2)
    rows = [
        (d, p, y, rnd.random()) for d in range(5) for p in R.CONTRAST_POPULATIONS for y in R.CONTRAST_COHORTS
    ]
    df = spark.createDataFrame(rows, "draw int, Population string, Year string, prediction double")
    contrasts = R.cell_contrasts()
    assert len(contrasts) == 36 and len(R.population_contrasts()) == 15
    wide = R.to_wide(df, ["draw"], ["Population", "Year"], R.contrast_cells(contrasts), "prediction")
    a = {(r.draw, r["var"]): r.dif for r in R.contrasts_from_wide(wide, contrasts).collect()}
    keyed = df.withColumn("cell", C.key_text("Population", "Year", sep="_"))
    b = {(r.draw, r["var"]): r.dif for r in R.contrasts_from_long(keyed, "cell", "prediction", contrasts).collect()}
    assert a == pytest.approx(b)
    back = [(n, r, left) for n, left, r in contrasts]
    c = {(r.draw, r["var"]): r.dif for r in R.contrasts_from_wide(wide, back).collect()}
    assert c == pytest.approx({k: -v for k, v in a.items()})


CLIMATE = "ID1 string, Year int, PPT_wt double, MAP double, MAT double"


def test_anomaly_edges(spark):
    rows = [
        ("a", 2000, 10.0), ("a", 2001, 20.0), ("a", 2005, 40.0), ("a", 2005, 50.0),
        ("no_event", 2000, 7.0), ("no_base", 2005, 9.0),
        ("gap", 2000, None), ("gap", 2001, 1.0), ("gap", 2005, 2.0),
    ]
    df = spark.createDataFrame([(s, y, v, v, v) for s, y, v in rows], CLIMATE)
    out = K.anomaly(df, "PPT_wt", (2000, 2001), (2005, 2006))
    got = {r.ID1: (r.Year, r.baseline_mean, r.event_mean, r.anomaly) for r in out.collect()}
    assert got == {
        "a": (2005, 15.0, 45.0, 30.0),
        "no_event": (None, 7.0, None, None),
        "gap": (2005, None, 2.0, None),
    }
    assert {r.ID1: r.mean_anomaly for r in K.mean_anomaly(out).collect()}["no_event"] is None


def test_periods_may_overlap_and_roster(spark):
    df = spark.createDataFrame([("a", y, float(y), 1.0, None) for y in range(2000, 2006)], CLIMATE)
    got = {r.period: r.cv_PPTwt for r in K.compare_periods(df, {"x": (2000, 2003), "y": (2002, 2005)}).collect()}
    want = lambda v: np.std(v, ddof=1) / np.mean(v)
    assert got == pytest.approx({"x": want(range(2000, 2004)), "y": want(range(2002, 2006))})
    places = spark.createDataFrame([("N_garden", 1.0, 2.0), ("N1", 3.0, 4.0), ("N1", 3.0, 4.0)], "ID1 string, Latitude double, Longitude double")
    assert {r.ID1: r.ID for r in K.site_roster(places).collect()} == {
        "N_garden": "common garden", "N1": "focal population"
    }


def test_smooth_recovers_a_parabola(spark):
    rows = [("s", 2000 + i, 3.0 - 2.0 * i + 0.5 * i * i, 0.0, 0.0) for i in range(12)]
    out = K.smooth_trend(spark.createDataFrame(rows, CLIMATE), "Year", "PPT_wt", "ID1", n=23).collect()
    assert len(out) == 23
    for r in out:
        i = r.Year - 2000
        assert r.smooth == pytest.approx(3.0 - 2.0 * i + 0.5 * i * i, abs=1e-8)
