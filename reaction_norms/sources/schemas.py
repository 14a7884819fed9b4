"""Fixed column contracts of the input and hand-off tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The plant-table data dictionary.
PLANTS = T.StructType(
    [
        T.StructField("garden", T.StringType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("garden_block", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("rowPosition", T.StringType()),
        T.StructField("Cross_ID_Rep", T.StringType()),
        T.StructField("Cross_ID", T.StringType()),
        T.StructField("Sire_ID", T.StringType()),
        T.StructField("Dam_ID", T.StringType()),
        T.StructField("Population", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Year1", T.StringType()),
        T.StructField("Date_early", T.DateType()),
        T.StructField("Time1_early", T.DoubleType()),
        T.StructField("log_VPDleaf_early", T.DoubleType()),
        T.StructField("gsw_early", T.DoubleType()),
        T.StructField("freshMass_g", T.DoubleType()),
        T.StructField("dryMass_g", T.DoubleType()),
        T.StructField("leafArea_cm2", T.DoubleType()),
        T.StructField("lma_g_per_m2", T.DoubleType()),
        T.StructField("sla_cm2_per_g", T.DoubleType()),
        T.StructField("ldmc", T.DoubleType()),
        T.StructField("L1", T.DoubleType()),
        T.StructField("L2", T.DoubleType()),
        T.StructField("L3", T.DoubleType()),
        T.StructField("totalStemLen", T.DoubleType()),
        T.StructField("first_flower_date", T.DateType()),
        T.StructField("first_flower_doy", T.DoubleType()),
        T.StructField("last_flower_date", T.DateType()),
        T.StructField("last_flower_doy", T.DoubleType()),
        T.StructField("flowering_duration", T.DoubleType()),
        T.StructField("Date_late", T.DateType()),
        T.StructField("Time1_late", T.DoubleType()),
        T.StructField("log_VPDleaf_late", T.DoubleType()),
        T.StructField("gsw_late", T.DoubleType()),
        T.StructField("maxHeight", T.DoubleType()),
        T.StructField("repBranchN", T.DoubleType()),
        T.StructField("RScount1", T.DoubleType()),
        T.StructField("RScount2", T.DoubleType()),
        T.StructField("RScount3", T.DoubleType()),
        T.StructField("totalRS", T.DoubleType()),
    ]
)

# The climate columns used downstream.
CLIMATE = T.StructType(
    [
        T.StructField("ID1", T.StringType()),
        T.StructField("ID2", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("MAP", T.DoubleType()),
        T.StructField("PPT_wt", T.DoubleType()),
        T.StructField("MAT", T.DoubleType()),
        T.StructField("Tmax_sm", T.DoubleType()),
        T.StructField("CMD", T.DoubleType()),
    ]
)


def plasticity_schema(trait: str) -> T.StructType:
    """Hand-off schema of one trait's family index."""
    keys = [T.StructField(k, T.StringType()) for k in ("Dam_ID", "pop_year", "Population", "Year")]
    return T.StructType([*keys, T.StructField(f"{trait}_plasticity", T.DoubleType())])


TERMS = T.StructType(
    [T.StructField("idx", T.IntegerType(), True), T.StructField("name", T.StringType(), True)]
)

DRAWS = T.StructType(
    [
        T.StructField("draw", T.LongType(), True),
        T.StructField("beta", T.ArrayType(T.DoubleType()), True),
        T.StructField("sigma", T.DoubleType(), True),
    ]
)
