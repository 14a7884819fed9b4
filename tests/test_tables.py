import pytest
from pyspark.sql import functions as F

from reaction_norms.models import gaussian as M
from reaction_norms.models.design import Design
from reaction_norms.operators import plasticity as P
from reaction_norms.operators import selection as S
from reaction_norms.sources import bindings as B
from reaction_norms.sources import schemas, tables


def test_csv_missing_text_and_column_order(spark, tmp_path):
    path = tmp_path / "plants.csv"
    path.write_text(
        "Year,garden,Dam_ID,first_flower_doy,first_flower_date,extra\n"
        "2010,north,f1,150.5,2023-05-30,z\nNA,south,NA,NA,NA,NA\n"
    )
    df = tables.read_plants(spark, str(path))
    assert df.schema == schemas.PLANTS
    a, b = df.orderBy(F.col("Year").desc_nulls_last()).collect()
    assert (a.Year, a.garden, a.Dam_ID, a.first_flower_doy) == (2010, "north", "f1", 150.5)
    assert str(a.first_flower_date) == "2023-05-30" and a.totalRS is None
    assert (b.Year, b.Dam_ID, b.first_flower_doy) == (None, None, None)
    clim = tmp_path / "climate.csv"
    clim.write_text("ID1,ID2,Year,Latitude,Longitude,MAP,PPT_wt,MAT,Tmax_sm,CMD\nN1,x,2000,1,2,3,NA,5,6,7\n")
    row = tables.read_climate(spark, str(clim)).first()
    assert (row.Year, row.MAP, row.PPT_wt) == (2000, 3.0, None)


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "climate"
    folder.mkdir()
    (folder / "a.csv").write_text("ID1,Year,MAP,PPT_wt\nN1,2000,10,20\n")
    (folder / "b.csv").write_text("ID1,Year,MAP,PPT_wt\nN2,2000,10,20\n")
    assert [(r.MAP, r.PPT_wt) for r in tables.read_climate(spark, str(folder)).collect()] == [(10.0, 20.0)] * 2
    (folder / "c.csv").write_text("ID1,Year,PPT_wt,MAP\nN3,2000,20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_climate(spark, str(folder)).collect()


def test_directions_of_many_environments(spark):
    means = spark.range(1200).select(F.col("id").cast("string").alias("garden"), F.col("id").cast("double").alias("m"))
    assert P.subtraction_pairs(means, "m").count() == 1200 * 1199 // 2


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_index_round_trip(spark, sf, tmp_path, fmt):
    index = P.plasticity_index(B.plants(spark, sf), P.DOY).withColumn(
        "doy_plasticity", F.when(F.col("Dam_ID") != "1", F.col("doy_plasticity"))
    )
    tables.write_table(index, str(tmp_path / "doy"), fmt)
    back = tables.read_plasticity(spark, str(tmp_path / "doy"), "doy", fmt)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, index.collect()))


def test_fit_round_trip(spark, sf, tmp_path):
    index = P.plasticity_index(B.plants(spark, sf), P.DOY)
    design = Design("doy_plasticity", ("C1", "N1"), ("2010", "2017"))
    fit = M.fit_gaussian(index, design)
    tables.save_fit(fit.terms(spark), fit.draws(spark, 10), str(tmp_path / "fit"))
    terms, draws = tables.load_fit(spark, str(tmp_path / "fit"))
    assert [r.name for r in terms.orderBy("idx").collect()] == list(design.terms)
    want = {r.draw: r.beta for r in fit.draws(spark, 10).collect()}
    assert {r.draw: r.beta for r in draws.collect()} == want


def test_selection_join_quirks(spark):
    plants = spark.createDataFrame(
        [("a", "N1", 2010, 4.0), ("a", "N1", 2010, None), ("a", "N1", 2017, 2.0), ("b", "S1", 2010, None), (None, "S1", 2010, 6.0)],
        "Dam_ID string, Population string, Year int, totalRS double",
    )
    index = lambda rows, n: spark.createDataFrame(
        rows, f"Dam_ID string, pop_year string, Population string, Year string, {n}_plasticity double"
    )
    indices = {
        "doy": index([("a", "N1-2010", "N1", "2010", 1.0), ("a", "N1-2017", "N1", "2017", 3.0), (None, "S1-2010", "S1", "2010", 7.0)], "doy"),
        "sla": index([("a", "N1-2010", "N1", "2010", 5.0), ("b", "S1-2010", "S1", "2010", 9.0)], "sla"),
    }
    rows = S.selection_table(plants, indices).collect()
    assert len(rows) == 6
    assert {(r.Dam_ID, r.Year, r.mean_rs, r.doy_pp, r.sla_pp, r.doy_pp2) for r in rows} == {
        # Joined on the family alone, each cohort meets both index rows.
        ("a", 2010, 4.0, 1.0, 5.0, 1.0),
        ("a", 2010, 4.0, 3.0, 5.0, 9.0),
        ("a", 2017, 2.0, 1.0, 5.0, 1.0),
        ("a", 2017, 2.0, 3.0, 5.0, 9.0),
        # b has no row of the first trait, so its second trait is lost; its fitness is missing.
        ("b", 2010, None, None, None, None),
        (None, 2010, 6.0, 7.0, None, 49.0),
    }
    apart = S.selection_table(plants, indices, on=("Dam_ID", "pop_year")).collect()
    assert {(r.Dam_ID, r.Year, r.doy_pp, r.sla_pp) for r in apart} == {
        ("a", 2010, 1.0, 5.0), ("a", 2017, 3.0, None), ("b", 2010, None, None), (None, 2010, 7.0, None)
    }


def test_intermediates_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from reaction_norms import session

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    df = spark.range(10).withColumn("v", F.col("id") * 2.0)
    stored = session.materialize(df)
    assert stored.schema.names == df.schema.names and stored.count() == 10
    assert str(tmp_path) in stored.inputFiles()[0]
    monkeypatch.setattr(session, "shared_folder", lambda _: None)
    assert session.materialize(df) is df


def test_standardize(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 5.0) for i in range(1, 20)], "a double, b double, c double")
    z = S.standardize(df, ["a", "b", "c"], {"rel": "a"})
    r = z.agg(F.avg("a_z"), F.stddev("a_z"), F.avg("b_z"), F.stddev("b_z"), F.avg("rel"), F.count("c_z")).first()
    assert tuple(r) == pytest.approx((0, 1, 0, 1, 1, 0), abs=1e-12)


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if "== Final Plan ==" in text else text, text


def test_index_plan(spark, sf):
    """One scan of the plants, partial aggregation before the shuffle, no pair join."""
    df = P.plasticity_index(B.plants(spark, sf), P.DOY)
    final, text = executed(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in text
    assert "ReusedExchange" in text and "partial_sum" in text
    # Pushed to the scan on a real plant table.
    plants = spark.createDataFrame([], schemas.PLANTS)
    import tempfile

    path = tempfile.mkdtemp() + "/plants"
    plants.write.parquet(path)
    stored = P.plasticity_index(tables.read_plants(spark, path, "parquet"), P.DOY)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(first_flower_doy)" in plan
    assert "ReadSchema: struct<garden:string,Dam_ID:string,Population:string,Year:int,first_flower_doy:double>" in plan


def test_no_single_partition_shuffle_of_rows(spark, sf):
    """Only partial aggregates may meet in one partition."""
    plants = B.plants(spark, sf)
    table = S.standardized_selection(S.selection_table(plants, S.indices_by_trait(plants)), ["doy", "sla", "ldmc"])
    text = table._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[i + 1]
    assert "Window [avg" not in text


def test_registered_plans_have_no_cross_product(spark, sf):
    from reaction_norms.plans.registry import QUERIES

    for name in ("pairs_doy", "sample_sizes", "conditional_effects", "pd_back_join", "period_cv", "level_cells"):
        text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
