"""A set of tables that is saved, backed up and brought back as a whole.

A set lives in a folder: `data-*` folders hold its tables, and the published table `state` says which of them are the set now.
Backups are `snapshot-*` folders, and the published table `manifest` has a row for each of their files with its checksum.
Whatever is written is written first and published last, so a writer that stops between two steps leaves what readers had.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.sources.files import broken_files, checksums, publish

MANIFEST = "snapshot string, number long, name string, path string, sha256 string, bytes long, notes string"


class SnapshotError(RuntimeError):
    """A backup that isn't there, or isn't whole."""


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save(spark: SparkSession, base: str, tables: dict[str, DataFrame], before: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
    """Make `tables` the set. `before` gets the tables as written and may refuse them, or bring an index up to date: readers see
    the new set after it."""
    folder = f"{base}/data-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    if before is not None:
        before({name: spark.read.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in tables.items()})
    publish(spark, f"{base}/state", spark.createDataFrame([(name, f"{folder}/{name}") for name in sorted(tables)], "name string, path string"))


def load(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The set as it is now; empty before the first save."""
    state = publish(spark, f"{base}/state")
    return {} if state is None else {r.name: spark.read.parquet(r.path) for r in state.collect()}  # a row for each table


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """A row for each file of each backup."""
    rows = publish(spark, f"{base}/manifest")
    return spark.createDataFrame([], MANIFEST) if rows is None else rows


def latest(spark: SparkSession, base: str) -> str | None:
    row = manifest(spark, base).agg(F.max_by("snapshot", "number").alias("s")).first()
    return row.s


def entry(spark: SparkSession, base: str, snapshot: str | None = None) -> DataFrame:
    """The manifest's rows of a backup, or of the latest."""
    name = snapshot or latest(spark, base)
    rows = manifest(spark, base).where(F.col("snapshot") == name) if name else None
    if rows is None or rows.isEmpty():
        raise SnapshotError(f"no backup {snapshot or ''} in {base}")
    return rows


def note(spark: SparkSession, base: str, snapshot: str, notes: str) -> None:
    """Change the notes of a backup."""
    entry(spark, base, snapshot)
    publish(spark, f"{base}/manifest", manifest(spark, base).withColumn("notes", F.when(F.col("snapshot") == snapshot, notes).otherwise(F.col("notes"))))


def create(spark: SparkSession, base: str, *, notes: str = "", keep: int = 10) -> str:
    """Back up the set and prune backups beyond the newest `keep`; the name of the backup.

    Tables are copied and their files' checksums taken before the manifest names them; pruned backups leave the
    manifest before their files go.
    """
    tables = load(spark, base)
    if not tables:
        raise SnapshotError(f"nothing is saved in {base}")
    old = manifest(spark, base)
    number = (old.agg(F.max("number").alias("n")).first().n or 0) + 1
    snapshot = f"snapshot-{number:010d}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{base}/{snapshot}/{name}")
    files = checksums(spark, f"{base}/{snapshot}").withColumn("name", F.element_at(F.split("path", "/"), -2))
    new = files.select(F.lit(snapshot).alias("snapshot"), F.lit(number).cast("long").alias("number"), "name", "path", "sha256", "bytes", F.lit(notes).alias("notes"))
    publish(spark, f"{base}/manifest", old.unionByName(new))
    prune(spark, base, keep=keep)
    return snapshot


def prune(spark: SparkSession, base: str, *, keep: int) -> list[str]:
    """Drop all backups but the newest `keep`; the names of those that went."""
    rows = manifest(spark, base)
    names = [r.snapshot for r in rows.groupBy("snapshot").agg(F.max("number").alias("n")).orderBy(F.desc("n")).collect()]  # a row for each backup
    gone = names[max(1, keep) :]
    if gone:
        publish(spark, f"{base}/manifest", rows.where(~F.col("snapshot").isin(gone)))
        for name in gone:
            _delete(spark, f"{base}/{name}")
    return gone


def problems(spark: SparkSession, base: str, snapshot: str | None = None) -> DataFrame:
    """path, problem of a backup's files that are missing or changed; no rows for a whole one."""
    rows = entry(spark, base, snapshot)
    name = rows.first().snapshot
    try:
        now = checksums(spark, f"{base}/{name}").select("path", "sha256")
        now.schema  # a folder that isn't there is found by reading it
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        now = spark.createDataFrame([], "path string, sha256 string")
    return broken_files(rows, now)


def restore(spark: SparkSession, base: str, snapshot: str | None = None, before: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Bring a backup, or the latest, back as the set; its name. A backup that isn't whole changes nothing."""
    name = entry(spark, base, snapshot).first().snapshot
    bad = problems(spark, base, name).limit(10).collect()
    if bad:
        raise SnapshotError(f"{name}: {[tuple(r) for r in bad]}")
    tables = [r.name for r in entry(spark, base, name).select("name").distinct().collect()]
    save(spark, base, {t: spark.read.parquet(f"{base}/{name}/{t}") for t in tables}, before)
    return name
