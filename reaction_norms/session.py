"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "reaction_norms", cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _scratch_folder() -> str:
    return tempfile.mkdtemp(prefix="reaction_norms-")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``; without that setting, a
    scratch folder in local mode and None elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        return _scratch_folder()
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate once to the shared folder and read it back.

    A written table survives the loss of executors, cuts the lineage, and keeps
    column pruning and filter pushdown for its readers. Without a shared folder
    the plan is returned as it is and its readers recompute it.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/reaction_norms-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
