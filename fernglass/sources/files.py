"""Readers and writers: JSON with quarantine, JSON lines, CSV imports, text corpora, listings, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernglass.session import written


def read_json_array(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records of JSON array files, and the files' broken records for quarantine."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", "string") if isinstance(schema, str) else schema.add("_corrupt_record", "string")
    rows = written(spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path), "json")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select(F.lit(path).alias("path"), "_corrupt_record")


def read_json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are skipped, or fail the read when strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def append_json_lines(rows: DataFrame, path: str, *, fraction: float = 1.0, seed: int = 7) -> None:
    """Append rows, or a sample of them, to a folder of JSON lines."""
    (rows if fraction >= 1 else rows.sample(fraction, seed)).write.mode("append").json(path)


def import_entries_csv(spark: SparkSession, path: str, *, encoding: str = "UTF-8", default_category: str = "other") -> DataFrame:
    """Entries of CSV files with a header: rows without title, desc or areas are dropped; a missing category is the default;
    a JSON column `extras` and columns named extra_* or extra:* become one map."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    for c in ("title", "desc", "areas", "category", "extras"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    more = [c for c in raw.columns if c.startswith(("extra_", "extra:"))]
    own = F.coalesce(F.from_json("extras", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    side = F.map_filter(F.create_map(*[x for c in more for x in (F.lit(c[6:]), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull()) if more else F.expr("cast(map() as map<string,string>)")
    joined = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(side, k)), side)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = raw.where(~blank("title") & ~blank("desc") & ~blank("areas"))
    return rows.withColumn("extras", joined).withColumn("category", F.when(blank("category"), default_category).otherwise(F.trim("category"))).drop(*more)


def read_texts(spark: SparkSession, base: str, *, suffixes: tuple[str, ...] = ("txt",)) -> DataFrame:
    """part, file, text, mtime of <base>/<part>/*.txt: each file once, as a whole. UTF-8 with or without its
    mark, UTF-16 by its mark; what is neither is UTF-8 with its bad bytes replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", True).load(base)
    b = F.col("content")
    start = F.hex(F.substring(b, 1, 3))
    utf8 = F.try_validate_utf8(b.cast("string"))
    text = F.when(start.startswith("FFFE") | start.startswith("FEFF"), F.decode(b, "UTF-16")).otherwise(F.coalesce(utf8, F.make_valid_utf8(b.cast("string"))))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("part"), F.element_at(parts, -1).alias("file"), F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n").alias("text"), F.col("modificationTime").alias("mtime")).dropDuplicates(["part", "file"])


#: Encodings that bytes are tried in, in this order, each strictly; the last resort replaces what it can't read.
CSV_ENCODINGS, TEXT_ENCODINGS, LAST = ("utf-8-sig", "utf-8", "cp932", "shift_jis"), ("utf-8-sig", "utf-8", "cp932", "shift_jis", "utf-16"), "cp932"


def decoded(raw: bytes | None, encodings: tuple[str, ...] = TEXT_ENCODINGS) -> tuple[str | None, str | None]:
    """Text and encoding of bytes: the first of the encodings that reads them all, or the last resort with replacements."""
    if raw is None:
        return None, None
    for name in encodings:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode(LAST, "replace"), f"{LAST}(replace)"


def read_any_texts(spark: SparkSession, base: str, *, glob: str = "*", encodings: tuple[str, ...] = TEXT_ENCODINGS) -> DataFrame:
    """path, part, file, text, encoding, mtime of all files below a folder, whatever encodings they are in: one read of their bytes, each
    file decoded where it was read. Files with a byte order mark lose it; files of no bytes are no rows, since Spark reads none of them."""

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            got = [decoded(x, encodings) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.large_string()).cast(pa.string()), pa.array([g[1] for g in got], pa.string())], ["path", "mtime", "text", "encoding"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(base).select("path", "content", F.col("modificationTime").alias("mtime"))
    rows = files.mapInArrow(decode, "path string, mtime timestamp, text string, encoding string")
    parts = F.split("path", "/")
    return rows.select("path", F.element_at(parts, -2).alias("part"), F.element_at(parts, -1).alias("file"), "text", "encoding", "mtime")


def import_any_csv(spark: SparkSession, base: str, *, glob: str = "*.csv", default_category: str = "other") -> DataFrame:
    """As import_entries_csv, of files whose encodings differ and aren't known, with the `encoding` that was found.

    A file is one CSV with its own header; its records are read where its bytes are, and columns are found by name.
    """

    def read(batches):
        import csv
        import io
        import json

        import pyarrow as pa

        for b in batches:
            out = []
            for raw in b.column(0).to_pylist():
                text, encoding = decoded(raw, CSV_ENCODINGS)
                for r in csv.DictReader(io.StringIO(text, newline="")):
                    r = {(k or "").strip(): v for k, v in r.items() if isinstance(v, str)}
                    side = {k[6:]: v for k, v in r.items() if k.startswith(("extra_", "extra:")) and v != ""}
                    out.append((r.get("title"), r.get("desc"), r.get("areas"), r.get("category"), r.get("extras"), json.dumps(side), encoding))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["title", "desc", "areas", "category", "extras", "side", "encoding"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(base).select("content")
    rows = files.mapInArrow(read, "title string, desc string, areas string, category string, extras string, side string, encoding string")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    side = F.from_json("side", "map<string,string>")
    own = F.coalesce(F.from_json("extras", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    joined = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(side, k)), side)
    kept = rows.where(~blank("title") & ~blank("desc") & ~blank("areas"))
    return kept.select("title", "desc", "areas", F.when(blank("category"), default_category).otherwise(F.trim("category")).alias("category"), joined.alias("extras"), "encoding")


def list_files(spark: SparkSession, base: str, glob: str = "*") -> DataFrame:
    """path, name, ext, folder, bytes, mtime; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(base).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def folder_totals(files: DataFrame) -> DataFrame:
    """folder, files, bytes."""
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def checksums(spark: SparkSession, base: str) -> DataFrame:
    """path, sha256, bytes of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def broken_files(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """path, problem of manifest files that are gone or changed."""
    both = manifest.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "left")
    return both.where("is is null or was <> is").select("path", F.when(F.col("is").isNull(), "missing").otherwise("changed").alias("problem"))


def newer_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files of a listing that the target (by name) lacks or has in an older version."""
    t = target.select("name", F.col("mtime").alias("_t"))
    return source.join(t, "name", "left").where("_t is null or mtime > _t").drop("_t")


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, everything quoted, quotes doubled, newlines as \\n."""
    text = [F.regexp_replace(c, "\r?\n", "\\\\n").alias(c) if k == "string" else F.col(c) for c, k in rows.dtypes]
    rows.select(*text).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_text(rows: DataFrame, path: str, *, title: str, tags: str, areas: str, body: str) -> None:
    """Corpus texts of rows: title, tags, areas, body as lines of a text file set."""
    rows.select(F.concat_ws("\n", F.col(title), F.concat_ws(", ", tags), F.concat_ws(", ", areas), F.lit(""), F.col(body)).alias("value")).write.mode("overwrite").text(path)


def publish(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame | None:
    """The newest version of a table folder, or None; with rows, a new version is written first.

    A version is a Parquet folder whose name holds its number and a random part. It is written beside the table and moved to
    its name as a whole. Readers take the largest name, so at every moment there is a whole version, what a reader has
    opened isn't changed, and of two writers at the same moment one is the newest and none is lost."""
    jvm = spark._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def versions() -> list[str]:
        names = [f.getPath().getName() for f in fs.listStatus(at(""))] if fs.exists(at("")) else []
        return sorted(n for n in names if n.startswith("version-"))

    if rows is not None:
        draft, before = f"_draft-{uuid.uuid4().hex}", versions()
        rows.write.parquet(f"{path}/{draft}")
        number = int(before[-1].split("-")[1]) + 1 if before else 1
        fs.rename(at(draft), at(f"version-{number:010d}-{uuid.uuid4().hex}"))
    found = versions()
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None
