"""Session settings and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that large runs need.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def build(name: str = "fernglass", **more: str) -> SparkSession:
    """A session with the library's settings; `more` adds to them."""
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a session whose executors are this very process may go without
    the setting: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fernglass-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/fernglass-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and still there when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """Add `name`: each row's place from 1 in the order, over any number of partitions. Rows are dealt by range and written, so
    that the ranges are fixed; only their sizes meet in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_b"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i"))
    ranged = written(ranged, "numbered")
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return ranged.join(F.broadcast(before), "_b").withColumn(name, F.col("_o") + F.col("_i") + 1).drop("_b", "_i", "_o")
