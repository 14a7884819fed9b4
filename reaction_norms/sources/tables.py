"""Readers and writers: plant, climate, plasticity and fitted-model tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reaction_norms.sources import schemas

NA = "NA"


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        # Without inference this reads only the header. Columns are then bound by
        # name, so files with more, fewer or reordered columns meet the contract. All
        # files of a folder must share one header: Spark binds by position within a
        # read, so another header is an error.
        raw = spark.read.csv(path, header=True, nullValue=NA, inferSchema=False, enforceSchema=False)
        present = set(raw.columns)
        return raw.select(
            *[
                (F.col(f"`{f.name}`") if f.name in present else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in schema
            ]
        )
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format {fmt!r}: use csv or parquet")


def read_climate(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Site x year climate table; the text ``NA`` is NULL."""
    return _read(spark, path, schemas.CLIMATE, fmt)


def read_plants(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One row per plant; Parquet is the format to keep large tables in."""
    return _read(spark, path, schemas.PLANTS, fmt)


def read_plasticity(spark: SparkSession, path: str, trait: str, fmt: str = "parquet") -> DataFrame:
    """A saved family index of one trait (``doy``, ``sla``, ``ldmc``)."""
    return _read(spark, path, schemas.plasticity_schema(trait), fmt)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Save a hand-off table; NULL becomes ``NA`` in CSV."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True, nullValue=NA)
    else:
        raise ValueError(f"unknown format {fmt!r}: use csv or parquet")


def replace_family_table(df: DataFrame, name: str, path: str, buckets: int, family: str = "Dam_ID") -> None:
    """Save a hand-off table of the catalog, in buckets of the family and sorted by it.

    Tables saved with the same number of buckets meet by family without a shuffle. The rows are written
    to a version of their own below ``path`` first; only then does ``name``, a view, point to
    it. A write that fails leaves the version before in its place, readers of which are not disturbed.
    """
    spark = df.sparkSession
    version = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, family).sortBy(family).option("path", f"{path.rstrip('/')}/{version}").saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{version}`")


def drop_old_versions(spark: SparkSession, name: str) -> None:
    """Forget the versions that ``name`` no longer points to; call it when no reader is left on them."""
    now = spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").where("col_name = 'View Text'").first()["data_type"]
    for t in spark.catalog.listTables():
        is_version = t.name.startswith(f"{name}_") and len(t.name) == len(name) + 33
        if is_version and t.name not in now:
            spark.sql(f"DROP TABLE `{t.name}`")


def family_table(spark: SparkSession, name: str) -> DataFrame:
    """The current version of a table of ``replace_family_table``."""
    return spark.table(name)


def save_fit(terms: DataFrame, draws: DataFrame, path: str) -> None:
    """Persist a fitted model as its term names and posterior draws."""
    write_table(terms, f"{path}/terms")
    write_table(draws, f"{path}/draws")


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read back ``(terms, draws)``."""
    return (
        spark.read.schema(schemas.TERMS).parquet(f"{path}/terms"),
        spark.read.schema(schemas.DRAWS).parquet(f"{path}/draws"),
    )
