"""Helpers that several training-data operators share: scratch tables, task code shipping, running totals."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task of whole texts works on at once: a few MB for common texts. Spark bounds its own batches by bytes.
TEXT_ROWS = 1024
#: White space between words, as ASCII has it.
WS = r"[\x20\x09-\x0D]+"

_made = threading.local()


def _tables() -> list[str | None]:
    """The working tables of this thread, so that queries in several threads leave each other's alone."""
    return _made.__dict__.setdefault("paths", [])


def prepare(spark: SparkSession) -> None:
    """See that there is a folder for working tables, and that executors have this package.

    spark.checkpoint.dir names the folder that the driver and all executors share. Only a session whose executors are
    this very process may go without one: it gets a temporary folder. Settings of the session stay as they are.
    """
    if not _shared(spark):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fernglass-"))
    root = str(Path(__file__).resolve().parents[2])
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if root not in on_path and not getattr(spark.sparkContext, "_fernglass_shipped", False):
        pack = Path(tempfile.mkdtemp(prefix="fernglass-")) / "fernglass.zip"
        with zipfile.ZipFile(pack, "w") as z:
            for p in Path(root, "fernglass").rglob("*.py"):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(str(pack))
        spark.sparkContext._fernglass_shipped = True


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster, kept in mind for release."""
    _tables().append(f"{_shared(spark).rstrip('/')}/fernglass-{name}-{uuid.uuid4().hex}")
    return _tables()[-1]


def made() -> int:
    """How many working tables there have been so far."""
    return len(_tables())


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the working tables from number `first` to before `last`. What is read from them must be written or collected."""
    jvm, tables = spark._jvm, _tables()
    for i, path in list(enumerate(tables))[first:last]:
        if path is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            tables[i] = None


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a cut of the lineage that outlives executors."""
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches: Iterator) -> Iterator:
    """Arrow batches as slices of at most TEXT_ROWS rows, none empty."""
    for b in batches:
        for i in range(0, b.num_rows, TEXT_ROWS):
            yield b.slice(i, TEXT_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one in the order, over any number of partitions.

    The rows are dealt by range, written once so that the ranges are fixed, summed by range, and added up inside each
    range. Only one row for each range meets in one task. Rows that are equal in the order come in any order.
    """
    spark = df.sparkSession
    ranged = written(df.withColumn("_v", value).repartitionByRange(partitions(spark), *order).withColumn("_b", F.spark_partition_id()), "range")
    sums = ranged.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(before, "_b").withColumn(out, F.col("_i") + F.col("_o")).drop("_v", "_b", "_i", "_o")
