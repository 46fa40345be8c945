"""Token counts of whole texts: a broadcast table of frequent pieces, worker caches for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import LONGEST, Encoder, encoder, texts

#: Pieces of the broadcast table, and items each sketch follows.
FREQUENT, FOLLOWED = 20_000, 50_000


def frequent_pieces(docs: DataFrame, text: str = "text", k: int = FREQUENT, followed: int = FOLLOWED) -> list[bytes]:
    """The k most frequent white-space-separated pieces of all texts, about; at most LONGEST bytes each.

    Every task folds its pieces into one sketch of bounded size; sketches are merged in two levels. No piece is shuffled.
    """
    pieces = docs.select(F.explode(F.split(F.col(text), common.WS)).alias("w")).where(F.col("w") != "").where(F.octet_length("w") <= LONGEST)
    parts = pieces.withColumn("g", F.spark_partition_id() % 64).groupBy("g").agg(F.expr(f"approx_top_k_accumulate(w, {followed})").alias("s"))
    # a grouped merge: a global one also merges the empty sketches of empty partitions, which fails
    top = parts.groupBy((F.col("g") * 0).alias("g")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {followed}), {k})").alias("top"))
    return sorted(r.w.encode() for r in top.select(F.explode("top.item").alias("w")).collect())


def count_tokens(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, limit: int = 2048) -> DataFrame:
    """Tokens of each whole text, without special tokens being added.

    One row per input row: doc_id, n_bytes, n_tokens, over_limit. Null texts count as empty ones: 0 and 0. Null ids,
    repeated rows and ids stay as they are; further columns are left out. The frequent table has a fixed size, so its
    broadcast doesn't grow; it only saves time, a piece not in it is encoded by the library and kept in the worker.
    Tokenizers whose pieces depend on white space (byte-level with leading spaces, sentencepiece) encode whole texts.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    enc = Encoder(tokenizer, count=True)
    table = {} if enc.whole else {w: enc.length(w) for w in frequent_pieces(docs, text, frequent)}
    shared = spark.sparkContext.broadcast(table)

    def count(batches):
        import pyarrow as pa

        enc = encoder(tokenizer, True, shared.value)
        for b in common.small(batches):
            all_texts = texts(b.column(1))
            n = [enc.length(t) for t in all_texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, all_texts), pa.int64()), pa.array(n, pa.int64()), pa.array((x > limit for x in n), pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
