"""Views that give generic order/part tables the plant, climate and draw shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reaction_norms.models.design import Design
from reaction_norms.operators.reshape import to_wide
from reaction_norms.sources.facts import JoinedPlants
from reaction_norms.sources.schemas import TERMS

GARDEN_OF_FLAG = {"N": "north", "R": "south", "A": "center"}
POPULATION_OF_TYPE = {
    "ECONOMY": "N1",
    "LARGE": "N2",
    "MEDIUM": "C1",
    "PROMO": "C2",
    "SMALL": "S1",
    "STANDARD": "S2",
}
GARDEN_SITES = ("NATION_6", "NATION_7", "NATION_8")
BASELINE_YEARS = (1995, 1998)
CONTEMPORARY_YEARS = (1999, 2001)
EVENT_YEARS = (1999, 2000)
DRAWS_PER_TABLE = 200


# The columns used, so that opening a table starts no schema-inference job.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_returnflag string",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint, p_type string, p_size int",
    "orders": "o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _recode(col: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out


def _cents(name: str) -> Column:
    """Whole hundredths as a double: sums are exact, whatever order they are added in."""
    return F.round(F.col(name) * 100)


def joined_plants(spark: SparkSession, sf_dir: str) -> JoinedPlants:
    """Order lines as measurements and parts as families, return flag = garden."""
    line = table(spark, sf_dir, "lineitem")
    number, garden = F.col("l_linenumber"), _recode(F.col("l_returnflag"), GARDEN_OF_FLAG)
    leaf = garden != "center"
    facts = line.select(
        F.col("l_partkey").alias("family_key"),
        garden.alias("garden"),
        F.when(number <= 2, F.col("l_quantity")).alias("first_flower_doy"),
        F.when(number.isin(3, 4) & leaf, _cents("l_extendedprice")).alias("sla_cm2_per_g"),
        F.when(number.isin(4, 5) & leaf, _cents("l_discount")).alias("ldmc"),
        F.when(number != 7, _cents("l_extendedprice")).alias("totalRS"),
        F.col("l_orderkey"),
        F.col("l_quantity"),
    )
    families = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("family_key"),
        F.col("p_partkey").cast("string").alias("Dam_ID"),
        _recode(F.col("p_type"), POPULATION_OF_TYPE).alias("Population"),
        F.when(F.col("p_size") % 2 == 0, 2010).otherwise(2017).alias("Year"),
    )
    return JoinedPlants(facts, families, "family_key")


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as plants, one row each."""
    names = ("garden", "Dam_ID", "Population", "Year", "first_flower_doy", "sla_cm2_per_g", "ldmc", "totalRS", "l_orderkey", "l_quantity")
    return joined_plants(spark, sf_dir).select(*names)


def two_cohort_plants(spark: SparkSession, sf_dir: str) -> JoinedPlants:
    """Order lines as plants of families that were collected twice: supplier x cohort = family.

    A family keeps its name and population over both cohorts, so the key of its rows is name and cohort.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    year = F.when(F.col("p_size") % 2 == 0, 2010).otherwise(2017)
    number, garden = F.col("l_linenumber"), _recode(F.col("l_returnflag"), GARDEN_OF_FLAG)
    leaf = garden != "center"
    facts = line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("/", F.col("l_suppkey"), year).alias("family_key"),
        garden.alias("garden"),
        F.when(number <= 2, F.col("l_quantity")).alias("first_flower_doy"),
        F.when(number.isin(3, 4) & leaf, _cents("l_extendedprice")).alias("sla_cm2_per_g"),
        F.when(number.isin(4, 5) & leaf, _cents("l_discount")).alias("ldmc"),
        F.when(number != 7, _cents("l_extendedprice")).alias("totalRS"),
    )
    suppliers = table(spark, sf_dir, "supplier")
    names = F.array(*[F.lit(p) for p in sorted(POPULATION_OF_TYPE.values())])
    families = suppliers.select("s_suppkey", F.explode(F.array(F.lit(2010), F.lit(2017))).alias("Year")).select(
        F.concat_ws("/", F.col("s_suppkey"), F.col("Year")).alias("family_key"),
        F.col("s_suppkey").cast("string").alias("Dam_ID"),
        F.get(names, (F.col("s_suppkey") % len(POPULATION_OF_TYPE)).cast("int")).alias("Population"),
        "Year",
    )
    return JoinedPlants(facts, families, "family_key", unique=("Dam_ID", "Year"))


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a site x year climate table: nation = site."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .groupBy("c_nationkey", F.year("o_orderdate").alias("Year"))
        .agg(
            F.avg(_cents("o_totalprice")).alias("PPT_wt"),
            F.sum(_cents("o_totalprice")).alias("MAP"),
            F.avg(_cents("c_acctbal")).alias("MAT"),
        )
        .join(nation, F.col("c_nationkey") == nation["n_nationkey"])
        .select(
            F.col("n_name").alias("ID1"),
            "Year",
            F.col("n_nationkey").cast("double").alias("Latitude"),
            F.col("n_regionkey").cast("double").alias("Longitude"),
            "PPT_wt",
            "MAP",
            "MAT",
        )
    )


def draw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw x population x cohort table: order lines averaged within each draw group."""
    return (
        plants(spark, sf_dir)
        .groupBy((F.col("l_orderkey") % DRAWS_PER_TABLE).alias("draw"), "Population", "Year")
        .agg(F.avg("l_quantity").alias("prediction"))
    )


#: What the first cohort's quantities are raised by, so that contrasts range from none to plain.
COHORT_EFFECT = {"N1": 0.0, "N2": 4.0, "C1": 8.0, "C2": 10.0, "S1": 14.0, "S2": 30.0}


def shifted_draw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw table with an effect of the cohort that differs by population."""
    effect = F.coalesce(*[F.when(F.col("Population") == p, e) for p, e in COHORT_EFFECT.items()])
    raised = F.col("prediction") + F.when(F.col("Year") == 2010, effect).otherwise(0.0)
    return draw_table(spark, sf_dir).withColumn("prediction", raised)


BOUND_COVARIATE = "doy_pp_z"
BOUND_DESIGN = Design(
    "fitness_rel", tuple(sorted(POPULATION_OF_TYPE.values())), ("2010", "2017"), (BOUND_COVARIATE,)
)


def coefficient_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BOUND_DESIGN.terms)), TERMS)


def coefficient_draws(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """A (draw, beta, sigma) table solved from the draw table (or another table ``cells`` like it).

    The coefficients reproduce its cell values, and each population's slope is its
    change between the cohorts, so every table computed from them can be checked in SQL.
    A coefficient vector needs every cell, so draws without one of them have no row.
    """
    pops, (y0, y1) = BOUND_DESIGN.populations, BOUND_DESIGN.years
    names = [f"{p}_{y}" for p in pops for y in (y0, y1)]
    cells = draw_table(spark, sf_dir) if cells is None else cells
    wide = to_wide(cells, ["draw"], ["Population", "Year"], names, "prediction")
    start = lambda p: F.col(f"{p}_{y0}")
    change = lambda p: F.col(f"{p}_{y1}") - F.col(f"{p}_{y0}")
    ref = pops[0]
    beta = {"Intercept": start(ref), f"Year{y1}": change(ref), BOUND_COVARIATE: change(ref)}
    for p in pops[1:]:
        beta[f"Population{p}"] = start(p) - start(ref)
        beta[f"Population{p}:Year{y1}"] = change(p) - change(ref)
        beta[f"Population{p}:{BOUND_COVARIATE}"] = change(p) - change(ref)
    return wide.dropna(subset=names).select(
        "draw",
        F.array(*[beta[t] for t in BOUND_DESIGN.terms]).alias("beta"),
        start(ref).alias("sigma"),
    )
