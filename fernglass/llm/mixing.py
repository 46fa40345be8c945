"""Mixing of sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common


@dataclass(frozen=True)
class Mix:
    """documents: one row per input row: row (its number), doc_id, digest, size (words), source, source_size, target.
    served: what the mix takes, a row for each part of a pass of a document: row, doc_id, digest, size, source, pass,
    first (words of the pass before it), words, finish (virtual time), place (words of the mix before it)."""

    documents: DataFrame
    served: DataFrame

    def in_order(self) -> DataFrame:
        """The mix itself, sorted by virtual finish time over all partitions: ranges of time hold about as many words each."""
        return by_finish(self.served, "finish", "place")

    def taken(self) -> DataFrame:
        """The documents with `taken`: the words that the mix takes, repeats counted."""
        words = self.served.groupBy("row").agg(F.sum("words").alias("taken"))
        return self.documents.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def by_finish(rows: DataFrame, finish: str, *ties: str) -> DataFrame:
    """Rows dealt by equal ranges of a virtual time from 0 to about 1, and sorted inside them."""
    n = common.partitions(rows.sparkSession)
    return rows.repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col(finish) * n)).cast("int")).sortWithinPartitions(finish, *ties)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, n, source_size, target from (source, size) rows.

    Sources in the order of their code points, null last, have the weights in turn. Targets share `share` times all sizes
    by weight; none is above `most` times its source, and what that takes off goes to the others by weight until none is
    above. Each round is one aggregate over the sources, of which two sums reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = common.running_total(sources, [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = common.written(ranked.select("source", "n", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("top")), "sources")
    total = ranked.agg(F.sum("source_size").alias("s")).first().s or 0
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("w") * level >= F.col("top")
        sums = ranked.agg(F.sum(F.when(capped, F.col("top")).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("w")).first()
        before, level = level, (share * total - sums.full) / sums.w if sums.w else level
        if level == before or not sums.w:
            break
    if level is None:
        return ranked.select("source", "n", "source_size", F.lit(0.0).alias("target"))
    return ranked.select("source", "n", "source_size", F.least(F.col("top"), F.col("w") * level).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 5, doc_id: str = "doc_id", text: str = "text", source: str = "source", identity: Column | None = None) -> Mix:
    """A mix of whole sources to target weights, each document at most `most` times; see Mix.

    Each source's documents stand in an order shuffled by hash, pass after pass. A document's virtual finish time is the
    words that its source has served up to its end, over the source's target. All passes are range-sorted by that time
    over all sources, and the mix is cut where the running total of words reaches the total budget. At time 1 every
    source has served its target, and together they have served the budget: the document that a source is serving then is
    parted at its target (in whole words), so that the cut leaves no source short by a long document.

    A null or empty text has size 0 and is never taken; a null source is a source; null, equal and repeated ids keep a
    row each; an empty table gives an empty mix. `identity` (a hash of the text unless given) becomes the digest, which
    orders rows of one id. Texts don't move; running totals are over ranges of (source, shuffle value) and of time, so a
    source with a third of all rows takes many tasks.
    """
    common.prepare(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.xxhash64(t) if identity is None else identity).alias("digest"), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.col(source).cast("string").alias("source"))
    rows = common.written(rows.withColumns({"u": F.xxhash64(F.lit(seed), "doc_id", "digest"), "row": F.monotonically_increasing_id()}), "sizes")
    sources = common.written(source_targets(rows, weights=weights, share=share, most=most), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("u"), F.col("doc_id"), F.col("digest"), F.col("row")]
    placed = common.written(common.running_total(rows, order, F.col("size"), "at"), "placed")
    first = placed.groupBy("source").agg(F.min("at").alias("zero"))  # the words of all sources before
    named = sources.join(first.withColumnRenamed("source", "_z"), F.col("source").eqNullSafe(F.col("_z"))).select(F.col("source").alias("_s"), "source_size", "target", "zero")
    documents = placed.join(named, F.col("source").eqNullSafe(F.col("_s"))).withColumn("at", F.col("at") - F.col("zero"))
    documents = documents.select("row", "doc_id", "digest", "size", "source", "source_size", "target", "at")

    passes = documents.where("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    start, goal = F.col("at") + F.col("pass") * F.col("source_size"), F.round("target").cast("long")
    early = F.greatest(F.lit(0), F.least(F.col("size"), goal - start))
    parts = F.array(
        F.struct(F.lit(0).cast("long").alias("first"), early.alias("words"), F.least(F.lit(1.0), (start + early) / F.col("target")).alias("finish")),
        F.struct(early.alias("first"), (F.col("size") - early).alias("words"), ((start + F.col("size")) / F.col("target")).alias("finish")),
    )
    parts = passes.select("row", "doc_id", "digest", "size", "source", "pass", F.explode(parts).alias("p")).select("row", "doc_id", "digest", "size", "source", "pass", "p.*").where("words > 0")
    budget = sources.agg(F.sum(goal)).first()[0] or 0
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("digest"), F.col("row"), F.col("pass"), F.col("first")]
    served = common.running_total(parts, order, F.col("words"), "place").where(F.col("place") < budget)
    served = common.written(served.withColumn("words", F.least(F.col("words"), budget - F.col("place"))), "mix")
    return Mix(documents.drop("at"), served)
