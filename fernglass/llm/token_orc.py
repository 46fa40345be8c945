"""Token ids in ORC: stripes of integer runs in ascending document order, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import encoder, texts


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encode every whole text and write doc_id, pos, n_tokens, ids to ORC files whose names follow ascending doc_id.

    `pos` is a row's place in its file. Null texts are the end id alone; null ids come first; repeated ids keep a row
    each. Texts, not ids, are dealt by range, so texts are encoded once. Integer run-length encoding is ORC's own for
    integer columns; each stripe has a row index and a Bloom filter on doc_id, so readers skip stripes by id.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        enc, end, pos = encoder(tokenizer), int(end_id).to_bytes(4, "little"), 0
        for b in common.small(batches):
            ids = [x + end for x in enc.encode_all(texts(b.column(1)))]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(pos, pos + len(ids))), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "pos", "n_tokens", "ids"])
            pos += len(ids)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    out = rows.mapInArrow(encode, "doc_id long, pos long, n_tokens long, ids array<int>")
    (out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows)).option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path))


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document in files of write_token_orc.

    `start` counts the ids of all documents before. It comes from the files' own lengths: one column is read, added up
    inside each file, and one total for each file is joined.
    """
    files = spark.read.orc(path).select("doc_id", "pos", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
    return files.join(_starts(spark, path), ["file", "pos"]).select("doc_id", "start", "n_tokens", "ids")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.orc(path).select("pos", "n_tokens", F.col("_metadata.file_name").alias("file"))
    return _with_start(rows, rows).select("file", "pos", "start")


def _with_start(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each file meets in one task: as many as the driver lists anyway. Files follow each other by the number in their
    name, which has more digits from the hundred thousandth on."""
    totals = lengths.groupBy("file").agg(F.sum("n_tokens").alias("t"))
    place = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    before = totals.select("file", F.coalesce(F.sum("t").over(Window.orderBy(place, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("i", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "file").withColumn("start", F.col("o") + F.col("i")).drop("o", "i")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files, read in parallel by stripe; ids stay in their tasks."""

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column(3)
            flat, off = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), np.uint32), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].data) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "pos", "n_tokens", "ids_crc32"])

    rows = spark.read.orc(path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "pos", "ids")
    rows = rows.mapInArrow(digest, "file string, doc_id long, pos long, n_tokens long, ids_crc32 long")
    lengths = spark.read.orc(path).select("n_tokens", F.col("_metadata.file_name").alias("file"))  # so that ids are read once
    return _with_start(rows, lengths).select("doc_id", F.col("start").cast("long"), "n_tokens", "ids_crc32")
