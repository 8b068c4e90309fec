"""Session defaults, scratch locations and input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Long expressions are built from many calls; recording the call site of each takes seconds.
CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


def get_spark(app: str = "inkblot", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the one the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CALL_SITES, "false")
        .config("spark.driver.memory", os.environ.get("INKBLOT_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def without_call_sites(spark: SparkSession) -> None:
    """Have a session that was made elsewhere skip the call sites too, if it still can."""
    try:
        spark.conf.set(CALL_SITES, "false")
    except Exception:  # a static setting in some versions: expressions are then built more slowly
        pass


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="inkblot-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one that the cluster names in ``spark.checkpoint.dir``.

    Only where everything runs on one machine may it be unset; a temporary folder serves then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to scratch and read it back, so that what is expensive is worked out once."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows_by_split(df: DataFrame) -> list[int]:
    """How many rows each split that has any really holds. No column is read: for Parquet, footers only."""
    counted = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count("*").alias("n"))
    return [row["n"] for row in counted.collect()]


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give every core work when the input's splits would not.

    Small files are read by one task each, and of a large one the splits say nothing: a row group goes whole to
    the split that holds its middle, so a file of one row group has a split for each core, and one of them has
    all rows. Such inputs, where a split has more than twice an even share, are dealt out by one shuffle; those
    of many even splits are left as they are: no shuffle of the texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        rows = _rows_by_split(df)
        if max(rows, default=0) * cores <= 2 * sum(rows):
            return df
    n = max(cores, splits)
    return df.repartition(n, key) if key else df.repartition(n)
