"""Similarity join of short texts by the ratio of matching blocks, without meeting all pairs.

The ratio is twice the characters in matching blocks over both lengths. The blocks stand in one order in both texts, so a ratio of
`cutoff` leaves few characters outside of them, and those bounds say by what a pair must meet:

* Texts that lose at most FEW characters each: what is left of both is equal. They meet by equal remainders, which are few
  for short texts, and only where the numbers of lost characters go together.
* Longer texts share most of their grams. Grams are put in order of how many texts have them, and a text is looked up
  by its rarest ones only: as many as the differing characters may spoil, and one more. Pairs whose lengths or numbers of shared
  grams can't reach the cutoff are dropped before they are rated.

A short text has some thousand remainders, of which Spark's guess by the files' size knows nothing, so joins are by merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.session import written

#: Characters that a text of the first kind may lose, and the lowest cutoff whose bounds hold.
FEW, LOWEST = 3, 0.8


def _lost_with(kept: int, cutoff: float) -> int:
    """How many characters two texts may have besides `kept` common ones: 2 * kept >= cutoff * (2 * kept + lost)."""
    return int(2 * kept * (1 - cutoff) / cutoff + 1e-9)


def longest_short(cutoff: float) -> int:
    """The longest texts of the first kind: none of them loses more than FEW characters in a pair; at most 64 characters."""
    n = FEW
    while n < 64 and all(_lost_with(n + 1 - lost, cutoff) < lost for lost in range(FEW + 1, n + 2)):
        n += 1
    return n


def gram_size(cutoff: float) -> int:
    return 3 if cutoff >= 0.9 else 2


def _remainders(text: Column, cutoff: float, longest: int) -> Column:
    """Structs (lost, rest) of a short text: itself, and what is left without each 1 to FEW characters."""
    level, out = F.array(text), [F.array(F.struct(F.lit(0).alias("lost"), text.alias("rest")))]
    least = {lost: min((n for n in range(lost, longest + 1) if _lost_with(n - lost, cutoff) >= lost), default=longest + 1) for lost in range(1, FEW + 1)}
    for lost in range(1, FEW + 1):
        shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        own = F.transform(level, lambda t: F.struct(F.lit(lost).alias("lost"), t.alias("rest")))  # noqa: B023
        out.append(F.when(F.length(text) >= least[lost], own).otherwise(F.array().cast("array<struct<lost: int, rest: string>>")))
    return F.flatten(F.array(*out))


def _short_pairs(left: DataFrame, right: DataFrame, cutoff: float, longest: int) -> DataFrame:
    """l, r of texts up to `longest` whose remainders are equal and whose lost characters together are few enough."""
    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        parts = rows.where(F.length("t") <= longest).select("t", F.explode(_remainders(F.col("t"), cutoff, longest)).alias("x"))
        kept = F.length("x.rest")
        # for each number that the other text may lose then, so that only numbers that go together meet
        most = F.least(F.lit(FEW), F.floor(2 * kept * ((1 - cutoff) / cutoff) + 1e-9).cast("int") - F.col("x.lost"))
        parts = parts.where(most >= 0).select(F.col("t").alias(own), F.xxhash64("x.rest").alias("h"), F.col("x.rest").alias("rest"), F.col("x.lost").alias(f"lost_{own}"), F.explode(F.sequence(F.lit(0), most)).alias(f"lost_{other}"))
        return parts

    return side(left, "l", "r").join(side(right, "r", "l").hint("merge"), ["h", "rest", "lost_l", "lost_r"]).select("l", "r").distinct()


def _numbered_grams(rows: DataFrame, q: int) -> DataFrame:
    """The columns of rows and g: each gram of t, equal ones told apart by their number."""
    grams = F.regexp_extract_all("t", F.lit("(?s)(?=(.{%d}))" % q), F.lit(1))
    counted = rows.select(*rows.columns, F.explode(grams).alias("g")).groupBy(*rows.columns, "g").agg(F.count("*").alias("c"))
    return counted.select(*rows.columns, "g", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("k")).withColumn("g", F.concat("g", F.col("k").cast("string"))).drop("k")


def _shared_at_least(n: Column, other: Column, cutoff: float, q: int) -> Column:
    """Grams that a text of n characters keeps beside one of `other`: a lost character spoils q of them, one put in q - 1."""
    kept = F.ceil(cutoff / 2 * (n + other) - 1e-9)
    return n - (q - 1) - q * (n - kept) - (q - 1) * (other - kept)


def _long_pairs(left: DataFrame, right: DataFrame, cutoff: float, longest: int) -> DataFrame:
    """l, r of texts of which one is longer than `longest`, by their rarest grams."""
    q, band = gram_size(cutoff), cutoff / (2 - cutoff)
    least = int((longest + 1) * band + 1 - 1e-9)  # the shortest text beside one that is longer
    both = left.select("t", F.lit(0).alias("s")).unionByName(right.select("t", F.lit(1).alias("s")))
    grams = _numbered_grams(both.where(F.length("t") >= least), q)
    have = grams.groupBy("g").agg(F.count("*").alias("n"))
    n = F.length("t")
    shortest, widest = F.ceil(n * band - 1e-9), F.floor(n / band + 1e-9)
    # the least over all lengths of a partner is at one of the ends: the bound is linear but for rounding
    spoiled = n - (q - 1) - F.least(_shared_at_least(n, shortest, cutoff, q), _shared_at_least(n, widest, cutoff, q), _shared_at_least(n, n, cutoff, q)) + q
    ordered = written(grams.join(have.hint("merge"), "g").groupBy("s", "t").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("x")).select("s", "t", F.col("x.g").alias("all")), "grams")
    asked = ordered.select("s", "t", F.explode(F.slice("all", F.lit(1), (spoiled + 1).cast("int"))).alias("g"))
    a, b = asked.where("s = 0").select(F.col("t").alias("l"), "g"), asked.where("s = 1").select(F.col("t").alias("r"), "g")
    lengths = (2 * F.least(F.length("l"), F.length("r")) >= F.lit(cutoff) * (F.length("l") + F.length("r")) - 1e-9) & (F.greatest(F.length("l"), F.length("r")) > longest)
    met = a.join(b.hint("merge"), "g").where(lengths).select("l", "r").distinct()
    whole_l, whole_r = ordered.where("s = 0").select(F.col("t").alias("l"), F.col("all").alias("of_l")), ordered.where("s = 1").select(F.col("t").alias("r"), F.col("all").alias("of_r"))
    enough = F.greatest(_shared_at_least(F.length("l"), F.length("r"), cutoff, q), _shared_at_least(F.length("r"), F.length("l"), cutoff, q))
    return met.join(whole_l.hint("merge"), "l").join(whole_r.hint("merge"), "r").where(F.size(F.array_intersect("of_l", "of_r")) >= enough).select("l", "r")


def candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """l, r: pairs of the texts in the columns t of both sides among which all pairs of a ratio of `cutoff` are; equal pairs once.
    Empty and null texts pair with nothing."""
    if not LOWEST <= cutoff <= 1:
        raise ValueError(f"the bounds hold for cutoffs from {LOWEST} to 1")
    sides = [x.select("t").where("t <> ''").distinct() for x in (left, right)]
    longest = longest_short(cutoff)
    return _short_pairs(*sides, cutoff, longest).unionByName(_long_pairs(*sides, cutoff, longest))


def close_pairs(left: DataFrame, right: DataFrame, cutoff: float = 0.92) -> DataFrame:
    """l, r, ratio of pairs (columns t) whose ratio of matching blocks is at least `cutoff`, r's blocks in l."""

    def rate(batches):
        import difflib

        import pyarrow as pa

        for b in batches:
            got, last, m = [], None, difflib.SequenceMatcher(None)
            for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t != last:  # what is known of the second text is kept
                    m.set_seq2(t)
                    last = t
                m.set_seq1(f)
                got.append(m.ratio())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["l", "r", "ratio"])

    return candidates(left, right, cutoff).mapInArrow(rate, "l string, r string, ratio double").where(F.col("ratio") >= cutoff)
