"""Joined plants against one table of plants, hand-off tables, sketches, and bindings with signal."""

import pytest
from pyspark.sql import functions as F

from reaction_norms.operators import plasticity as P
from reaction_norms.operators import selection as S
from reaction_norms.plans.registry import QUERIES
from reaction_norms.sources import bindings as B
from reaction_norms.sources import tables
from reaction_norms.sources.facts import JoinedPlants


@pytest.fixture(scope="module")
def two(spark):
    """Measurements with a key that has no family, missing values and a family without measurements."""
    facts = spark.createDataFrame(
        [(k % 9, g, float(k % 5 + i), float(k), None if k % 4 else float(i)) for k in range(90) for i, g in enumerate(("north", "south", "center"))],
        "key int, garden string, first_flower_doy double, sla_cm2_per_g double, ldmc double",
    ).withColumn("totalRS", F.col("sla_cm2_per_g") * 2)
    families = spark.createDataFrame(
        [(k, None if k == 3 else f"f{k % 5}", "N1" if k % 2 else "S1", 2010 if k < 5 else 2017) for k in (0, 1, 2, 3, 4, 5, 6, 40)],
        "key int, Dam_ID string, Population string, Year int",
    )
    return JoinedPlants(facts, families, "key", unique=("Dam_ID", "Year"))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", ["gate_table", "replicate_counts", "replicate_counts_wide", "eligible_families", "eligible_plants", "plasticity_index", "pair_totals", "replicate_differences", "pairwise_differences", "env_means", "mean_shift"])
@pytest.mark.parametrize("trait", [P.DOY, P.LDMC], ids=["doy", "ldmc"])
def test_operators_read_joined_plants_like_one_table(two, name, trait):
    fn = getattr(P, name)
    assert rows(fn(two, trait)) == rows(fn(two.rows(), trait))


def test_tables_of_several_traits(two):
    assert rows(P.sample_sizes(two)) == rows(P.sample_sizes(two.rows()))
    assert rows(S.family_fitness(two)) == rows(S.family_fitness(two.rows()))
    assert set(two.columns) == set(two.rows().columns)
    assert rows(two.groupBy("Dam_ID", "garden").agg(F.count("*").alias("n"))) == rows(two.rows().groupBy("Dam_ID", "garden").agg(F.count("*").alias("n")))
    assert rows(two.groupBy("garden").agg(F.count("*").alias("n"))) == rows(two.rows().groupBy("garden").agg(F.count("*").alias("n")))


def scans_shuffled_raw(text):
    """Exchanges whose input comes from the measurements without a partial aggregate in between."""
    lines, bad = text.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if "Exchange" not in line or "Broadcast" in line or "Reused" in line:
            continue
        below = []
        for other in lines[i + 1 :]:
            if depth(other) <= depth(line):
                break
            below.append(other)
        until = next((k for k, x in enumerate(below) if "partial_" in x or "Exchange" in x or "functions=[]" in x), len(below))
        if any("l_partkey" in x and "Scan parquet" in x for x in below[:until]):
            bad.append(line.strip()[:200])
    return bad


@pytest.mark.parametrize("name", ["plasticity_doy", "plasticity_sla", "plasticity_ldmc", "sample_sizes", "gate_doy", "pair_totals_doy", "family_fitness", "selection_z"])
def test_no_measurement_is_shuffled_before_it_is_reduced(spark, sf, name):
    """Without broadcasts: what meets the families is reduced already."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        raw = B.plants(spark, sf).groupBy("Dam_ID").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert scans_shuffled_raw(text) == []
    assert scans_shuffled_raw(raw)  # the check sees what it looks for


def test_bucketed_tables_meet_without_a_shuffle(spark, sf, tmp_path):
    stored = {}
    for name, index in S.indices_by_trait(B.joined_plants(spark, sf)).items():
        tables.replace_family_table(index, f"handoff_{name}", str(tmp_path), 4)
        stored[name] = tables.family_table(spark, f"handoff_{name}")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = S.join_traits(stored, null_safe=False)
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        semi = P.semi_join(stored["doy"], stored["sla"], "Dam_ID", null_safe=False)
        assert "Exchange" not in semi._jdf.queryExecution().executedPlan().toString()
        assert rows(joined) == rows(S.join_traits(S.indices_by_trait(B.plants(spark, sf))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "Dam_ID string, v int")
    tables.replace_family_table(good, "staged", str(tmp_path), 2)
    broken = good.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        tables.replace_family_table(broken, "staged", str(tmp_path), 2)
    assert rows(tables.family_table(spark, "staged")) == rows(good)
    tables.replace_family_table(good.withColumn("v", F.col("v") + 10), "staged", str(tmp_path), 2)
    assert sorted(r.v for r in tables.family_table(spark, "staged").collect()) == [11, 12]
    tables.drop_old_versions(spark, "staged")
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith("staged_")]
    assert len(left) == 1 and sorted(r.v for r in tables.family_table(spark, "staged").collect()) == [11, 12]


def test_united_sketches_count_families_once(spark, tmp_path):
    trait = P.LDMC
    def run(low, high):
        df = spark.range(low, high).select(
            F.concat(F.lit("f"), F.col("id")).alias("Dam_ID"), F.lit("N1").alias("Population"), F.lit(2010).alias("Year"),
            F.explode(F.array(*[F.lit(g) for g in ("north", "north", "south", "south")])).alias("garden"), F.lit(1.0).alias("ldmc"),
        )
        return P.size_sketches(df, [trait], lg_k=12)

    for i, span in enumerate([(0, 30_000), (20_000, 50_000)]):
        tables.write_table(run(*span), str(tmp_path / f"run{i}"))
    saved = [spark.read.parquet(str(tmp_path / f"run{i}")) for i in range(2)]
    r = P.united_sizes(saved[0].unionByName(saved[1]), [trait]).first()
    assert r.n_individuals == 240_000 and r.trait == trait.label
    # five standard errors
    assert abs(r.n_families - 50_000) < 5 * 50_000 * 0.8 / 2**6
    exact = P.united_sizes(run(0, 300), [trait]).first()
    assert exact.n_families == 300
    missing = spark.createDataFrame([(d, "N1", 2010, g, 1.0) for d in (None, "missing", "x") for g in ("north", "south") * 2], "Dam_ID string, Population string, Year int, garden string, ldmc double")
    assert P.united_sizes(P.size_sketches(missing, [trait]), [trait]).first().n_families == 3


def test_directions_come_from_many_tasks_and_break_ties_by_name(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 100)
    means = spark.range(1200).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("garden"), (F.col("id") % 1000).cast("double").alias("m"))
    pairs = P.subtraction_pairs(means, "m")
    got = {(r.garden_1, r.garden_2) for r in pairs.collect()}
    names = [(i % 1000, f"{i:04d}") for i in range(1200)]
    assert got == {(b[1], a[1]) for a in names for b in names if b > a} and pairs.count() == 719_400
    counts = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 1


def test_bindings_show_what_the_operators_are_for(spark):
    sf_dir = "/root/testdata/sf0.01"  # at sf0.001 some draws miss a cell
    assert {r.significance for r in QUERIES["stars_shifted"](spark, sf_dir).collect()} == {"", "*", "**", "***"}
    labels = {(r.Population, r.Year): r.sig for r in QUERIES["significance_shifted"](spark, sf_dir).collect()}
    assert set(labels.values()) == {"Significant", "Not Significant"}
    ribbon = {(r.Population, r.Year) for r in QUERIES["ribbon_significant"](spark, sf_dir).collect()}
    assert ribbon == {k for k, v in labels.items() if v == "Significant"}
    index = QUERIES["plasticity_two_cohorts"](spark, sf_dir).groupBy("Dam_ID").count()
    assert index.where("count = 2").count() > 0
    joined = QUERIES["trait_join_two_cohorts"](spark, sf_dir).groupBy("Dam_ID", "pop_year").count()
    assert joined.where("count > 1").count() > 0
    by_cohort = QUERIES["trait_join_by_cohort"](spark, sf_dir).groupBy("Dam_ID", "pop_year").count()
    assert by_cohort.where("count > 1").count() == 0
    whole, near = (QUERIES[n](spark, sf_dir).where("width > 0.9").collect() for n in ("halfeye_intervals", "halfeye_limited"))
    assert {r.Population: r.lower for r in whole} != {r.Population: r.lower for r in near}
