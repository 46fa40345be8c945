"""A training corpus from the documents table: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. SQL can't express the learned rules, the signatures and the
tokens, so there is no ORACLE_SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm import common, line_dedup, minhash, mixing, packing, quality_rules
from fernglass.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned rules keep (operator 8).

    A null or empty text fails the base. Every row is judged by itself, so repeated rows stay or go alike; columns come
    back as they were, whatever their names.
    """
    common.prepare(spark)
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = quality_rules.judge(plain, rules, text=_plain(docs, "text")).where("kept")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds (operator 10); those with no word left go, null and empty texts
    among them. n_chars is that of the text that is left; other columns come back as they were."""
    out = line_dedup.drop_lines(docs, counts=False).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by id, of each group of near duplicates by 5-word shingles (operator 9).

    Every row stands for itself, so that rows without an id, or of one id, are kept and dropped each by its own text. Rows
    are numbered by id, null last, and by hashes of the text. Texts without a word are linked with nothing and stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = F.coalesce(F.col(_plain(docs, "text")), F.lit("")), F.col(_plain(docs, "doc_id"))
    order = [key.asc_nulls_last(), F.xxhash64(text), F.xxhash64(F.lit(2), text)]
    ranged = docs.toDF(*names).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    rows = common.written(ranged.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, shingle=5, percent=80, doc_id="row", text=_plain(docs, "text"))
    gone = groups.where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*names).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, in the order of the mix (operator 5).

    A row is whole: the pass that runs when the budget ends is taken if at least half of it is. Rows that are equal in
    every column are one that is taken as often as they all are. Texts without a word are never taken; a null source is
    a source.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    digest, first = F.xxhash64(*names), common.made()
    mix = mixing.mix(plain, doc_id=_plain(docs, "doc_id"), text=_plain(docs, "text"), source=_plain(docs, "source"), identity=digest)
    passes = mix.served.groupBy("row", "pass").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("size").alias("size"), F.sum("words").alias("words"), F.min("finish").alias("finish"), F.min("place").alias("place"))
    common.release(spark, first, common.made() - 1)  # all but the mix itself
    last = F.lit((1 << 63) - 1)
    passes = passes.where(2 * F.col("words") >= F.col("size")).select(F.coalesce("doc_id", last).alias("key"), "digest", "finish", "place")
    rows = plain.select("*", F.coalesce(F.col(_plain(docs, "doc_id")).cast("long"), last).alias("key"), digest.alias("digest")).dropDuplicates(["key", "digest"])
    both = rows.join(passes, ["key", "digest"]).select(*names, "finish", "place")
    return mixing.by_finish(both, "finish", "place").select(*names).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens (operator 4): one row for each piece, with its ids' checksum.

    A null or empty text is its end id alone. Null, equal and repeated ids are packed as rows of their own.
    """
    return packing.pack(docs, tokenizer(), end_id=2)


def _plain(docs: DataFrame, name: str) -> str:
    """The place of a column as a name that no column of an operator has."""
    return f"c{docs.columns.index(name)}"


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixture", mixture), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the cluster's shared folder, and what a stage needed
    besides is deleted."""
    common.prepare(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        first = common.made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            table = common.made()
            docs = common.written(docs, name)
            common.release(spark, first, table)
            if before is not None:
                common.release(spark, before, before + 1)
            before = table
    return docs
