import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reaction_norms.operators import plasticity as P

SCHEMA = "Dam_ID string, Population string, Year int, garden string, first_flower_doy double, sla_cm2_per_g double, ldmc double"


def plants(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)


def family(dam, pop, year, north, south, center):
    return [
        (dam, pop, year, g, float(v))
        for g, values in (("north", north), ("south", south), ("center", center))
        for v in values
    ]


# Worked by hand. Minima: north 10, south 4, center 2.
GOLD = family("a", "N1", 2010, [10, 14], [4, 8, 6], [2, 6]) + family(
    "b", "S1", 2017, [12, 16, 20], [10, 12], [8, 4]
)


def reference(rows, trait=P.DOY):
    """The pair table by nested loops, as (family, pop_year) -> list of ratios."""
    by_gate = {}
    for dam, _, year, garden, v in rows:
        if v is not None:
            by_gate.setdefault((dam, year), {}).setdefault(garden, []).append(v)
    ok = {
        dam for (dam, _), g in by_gate.items() if all(len(g.get(e, [])) >= 2 for e in trait.envs)
    }
    kept = [r for r in rows if r[0] in ok and r[4] is not None]
    low = {}
    for r in kept:
        low[r[3]] = min(low.get(r[3], r[4]), r[4])
    if not trait.centered:
        low = dict.fromkeys(low, 0.0)
    values = [r[4] - low[r[3]] for r in kept]
    mean = sum(values) / len(values)
    cells = {}
    for (dam, pop, year, garden, _), v in zip(kept, values):
        if dam is not None and pop is not None:
            cells.setdefault((dam, pop, year), {}).setdefault(garden, []).append(v)
    out = {}
    for (dam, pop, year), g in cells.items():
        if all(len(g.get(e, [])) >= 2 for e in trait.envs):
            out[(dam, f"{pop}-{year}")] = [
                (a, b, x, y, (x - y) / mean)
                for a, b in trait.pairs
                for x, y in itertools.product(g[a], g[b])
            ]
    return out


def as_dict(df):
    return {(r[0], r[1]): r[-1] for r in df.collect()}


def expect_index(spark, rows, trait=P.DOY):
    want = {k: sum(p[-1] for p in v) / len(v) for k, v in reference(rows, trait).items()}
    got = as_dict(P.plasticity_index(plants(spark, rows), trait))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
    return got


def test_worked_example(spark):
    got = expect_index(spark, GOLD)
    # Family a, centred: north 0 4, south 0 4 2, center 0 4; every pair averages to 0.
    assert got[("a", "N1-2010")] == pytest.approx(0.0, abs=1e-15)
    # Family b: north 2 6 10, south 6 8, center 6 2. Pair sums: N-S 6*6-3*14=-6, N-C 2*18-3*8=12,
    # S-C 2*14-2*8=12; 18 over 16 pairs; global mean (4+6+4+18+14+8)/14.
    assert got[("b", "S1-2017")] == pytest.approx((18 / 16) / (54 / 14))


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        dam = rnd.choice(["f1", "f2", "f3", "f4", "f5", None])
        rows.append(
            (
                dam,
                rnd.choice(["N1", "C1", "S2", None]),
                rnd.choice([2010, 2017]),
                rnd.choice(["north", "south", "center", "other"]),
                rnd.choice([None, *map(float, range(1, 40))]),
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tables_match_nested_loops(spark, seed):
    rows = random_rows(seed)
    expect_index(spark, rows)
    pairs = P.pairwise_differences(plants(spark, rows), P.DOY).collect()
    want = sorted(
        (k[0], k[1], a, b, x, y, round(q, 9)) for k, v in reference(rows).items() for a, b, x, y, q in v
    )
    got = sorted(
        (r.Dam_ID, r.pop_year, r.garden_1, r.garden_2, r.doy_1, r.doy_2, round(r.ratio, 9))
        for r in pairs
        for _ in range(r.n_pairs)
    )
    assert got == want


def test_pairs_of_a_continuous_trait(spark):
    rnd = random.Random(8)
    rows = [(d, "N1", 2010, g, rnd.random()) for d in "ab" for g in ("north", "south") for _ in range(9)]
    table = spark.createDataFrame([(*r[:4], None, r[4], None) for r in rows], SCHEMA)
    got = sorted((r.Dam_ID, r.garden_1, r.sla_1, r.sla_2) for r in P.pairwise_differences(table, P.SLA).collect())
    want = sorted((k[0], a, x, y) for k, v in reference(rows, P.SLA).items() for a, _, x, y, _ in v)
    assert got == want and len(got) == 2 * 81


def test_replicate_differences_sum_the_pairs(spark):
    rows = random_rows(12)
    seen = {}
    for k, v in reference(rows).items():
        for a, b, x, y, ratio in v:
            seen.setdefault((*k, a, b, x), []).append((x - y, ratio))
    got = P.replicate_differences(plants(spark, rows), P.DOY).collect()
    assert len(got) == len(seen)
    for r in got:
        v = seen[r.Dam_ID, r.pop_year, r.garden_1, r.garden_2, r.doy_1]
        assert r.n_pairs == len(v)
        assert r.mean_difference == pytest.approx(sum(d for d, _ in v) / len(v), abs=1e-12)
        assert r.mean_ratio == pytest.approx(sum(q for _, q in v) / len(v), abs=1e-12)


def test_spread_pair_keys_change_nothing(spark, monkeypatch):
    rows = random_rows(7, 600)
    whole = P.pairwise_differences(plants(spark, rows), P.DOY)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(P, "CHUNK", 3)
    assert sorted(map(tuple, P.pairwise_differences(plants(spark, rows), P.DOY).collect())) == want


def test_reversed_pairs_and_rescaling(spark):
    rows = random_rows(4)
    table = plants(spark, rows)
    base = as_dict(P.plasticity_index(table, P.DOY))
    turned = replace(P.DOY, pairs=tuple((b, a) for a, b in P.DOY.pairs))
    for k, v in as_dict(P.plasticity_index(table, turned)).items():
        assert v == pytest.approx(-base[k], abs=1e-12)
    scaled = table.withColumn("first_flower_doy", F.col("first_flower_doy") * 8)
    for k, v in as_dict(P.plasticity_index(scaled, P.DOY)).items():
        assert v == pytest.approx(base[k], abs=1e-12)


def test_gate_counts_a_missing_garden_as_failed(spark):
    rows = family("a", "N1", 2010, [1, 2], [3, 4], []) + family("b", "N1", 2010, [1, 2], [3], [4, 5])
    gates = {r.Dam_ID: r for r in P.gate_table(plants(spark, rows), P.DOY).collect()}
    assert (gates["a"].N_center, gates["a"].both) == (0, 0)
    assert (gates["b"].N_south, gates["b"].both) == (0, 0)
    assert P.plasticity_index(plants(spark, rows), P.DOY).count() == 0


def test_family_eligible_in_one_cohort_keeps_every_cohort_for_the_mean(spark):
    rows = GOLD + family("a", "N1", 2017, [30], [31], [32])
    expect_index(spark, rows)
    table = plants(spark, rows)
    assert P.eligible_plants(table, P.DOY).count() == len(rows)
    sizes = {(r.Population, r.Year): (r.n_families, r.n_individuals) for r in P.sample_sizes(table, [P.DOY]).collect()}
    assert sizes[("N1", 2017)] == (1, 3)


def test_missing_family_is_gated_and_counted_but_not_indexed(spark):
    rows = GOLD + family(None, "C1", 2010, [11, 12], [5, 6], [3, 4])
    table = plants(spark, rows)
    assert P.eligible_plants(table, P.DOY).where("Dam_ID is null").count() == 6
    assert P.eligible_plants(table, P.DOY, null_safe=False).where("Dam_ID is null").count() == 0
    expect_index(spark, rows)
    sizes = {r.Population: r.n_families for r in P.sample_sizes(table, [P.DOY]).collect()}
    assert sizes["C1"] == 1


def test_all_traits_in_one_scan_equal_single_traits(spark):
    rnd = random.Random(5)
    rows = [
        (rnd.choice("abcd"), "N1", 2010, rnd.choice(["north", "south", "center"]),
         *[rnd.choice([None, rnd.random() * 9]) for _ in range(3)])
        for _ in range(300)
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    together = P.plasticity_indices(table).collect()
    assert len(together) > 6
    for t in P.TRAITS:
        alone = as_dict(P.plasticity_index(table, t))
        joint = {(r.Dam_ID, r.pop_year): r.plasticity for r in together if r.trait == t.name}
        assert joint.keys() == alone.keys()
        for k in alone:
            assert joint[k] == pytest.approx(alone[k], abs=1e-12)


def test_totals_agree_with_pairs(spark):
    rows = random_rows(9)
    table = plants(spark, rows)
    totals = {(r.Dam_ID, r.pop_year, r.garden_1, r.garden_2): r for r in P.pair_totals(table, P.DOY).collect()}
    seen = {}
    for k, pairs in reference(rows).items():
        for a, b, x, y, _ in pairs:
            seen.setdefault((*k, a, b), []).append(x - y)
    assert totals.keys() == seen.keys()
    for k, v in seen.items():
        assert totals[k].n_pairs == len(v)
        assert totals[k].mean_difference == pytest.approx(sum(v) / len(v))


def test_found_pairs_put_the_greater_mean_first(spark):
    found = P.with_found_pairs(plants(spark, GOLD), P.DOY)
    means = {r.garden: r.doy_mean for r in P.env_means(plants(spark, GOLD), P.DOY).collect()}
    assert all(means[a] >= means[b] for a, b in found.pairs)
    table = P.subtraction_pairs(P.env_means(plants(spark, GOLD), P.DOY), "doy_mean").collect()
    assert {(r.garden_1, r.garden_2) for r in table} == set(found.pairs)


def test_centering_keeps_a_missing_environment(spark):
    df = spark.createDataFrame([("x", 5.0), ("x", 7.0), (None, 3.0), (None, 9.0)], "garden string, v double")
    got = sorted(r.out for r in P.center_on_env_min(df, "v", out="out").collect())
    assert got == [0.0, 0.0, 2.0, 6.0]


def test_mean_shift_is_mean_index_times_global_mean(spark):
    row = P.mean_shift(plants(spark, GOLD), P.DOY).first()
    assert row.global_mean == pytest.approx(54 / 14)
    assert row.mean_shift == pytest.approx((18 / 16) / 2)
