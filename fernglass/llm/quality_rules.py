"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering, applied as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common

#: Labelled rows that a list is learned from, at most: those first in the order of a hash of their id.
SAMPLE = 20_000
#: What a condition may look at.
FEATURES = ("n_words", "word_length", "symbols", "marks", "upper", "digits", "dup_lines", "repeat_words", "distinct_words", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def text_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with the statistics of each whole text as further columns (names of its own columns that clash give way).

    Words are runs without ASCII white space; a null text has none. n_words, word_chars (code points in words), n_symbols
    (of #*$%&|<>), n_dup_lines (lines with a word, equal to an earlier one), n_repeat_words (words in 3-word windows that
    the text has twice or more), and the rates of FEATURES. Windows are compared by a 64-bit hash, sorted with their
    places inside the row where some are equal: those are neighbours then, and no row leaves its task.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES[1:]]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    own = lambda name: mark + name  # noqa: E731  a working column's name, which no column of the table has
    rows = docs.drop(*[c for c in added if c in docs.columns and c != text])
    rows = rows.withColumns({
        own("words"): F.filter(F.split(t, common.WS), lambda w: w != ""),
        own("lines"): F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        own("marks"): F.regexp_count(t, F.lit(r"[!?]")),
        own("upper"): F.regexp_count(t, F.lit(r"\p{Lu}")),
        own("digits"): F.regexp_count(t, F.lit(r"[0-9]")),
    })
    window = lambda i: F.xxhash64(F.get(own("words"), i), F.get(own("words"), i + 1), F.get(own("words"), i + 2))
    rows = rows.withColumn(own("hashes"), F.when(F.size(own("words")) >= 3, F.transform(F.sequence(F.lit(0), F.size(own("words")) - 3), window)))
    placed = F.transform(own("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn(own("sorted"), F.when(F.size(F.array_distinct(own("hashes"))) < F.size(own("hashes")), F.sort_array(placed)))
    near = lambda k: F.get(own("sorted"), k)["h"]
    again = F.filter(own("sorted"), lambda x, k: F.coalesce(x["h"] == F.when(k > 0, near(k - 1)), F.lit(False)) | F.coalesce(x["h"] == near(k + 1), F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["p"])).alias("n"), i.alias("p")), lambda a: a["n"])
    # A filter on a statistic must not be pushed below this projection: that would put the sorted windows inside the
    # functions that walk over them. A condition that counts as not deterministic, though always true, keeps it above.
    held = lambda c: F.when(F.spark_partition_id() >= 0, c)
    rows = rows.withColumns({
        "n_words": held(F.size(own("words")).cast("long")),
        "word_chars": held(F.length(F.array_join(own("words"), "")).cast("long")),
        "n_dup_lines": held((F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("long")),
        "n_repeat_words": held(F.coalesce(covered, F.lit(0)).cast("long")),
        own("n_lines"): held(F.size(own("lines"))),
        own("n_distinct"): held(F.size(F.array_distinct(own("words")))),
    })
    rate = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)).cast("double")
    rows = rows.withColumns({
        "word_length": rate("word_chars", "n_words"), "symbols": rate("n_symbols", "n_words"), "marks": rate(own("marks"), "n_words"), "upper": rate(own("upper"), "word_chars"), "digits": rate(own("digits"), "word_chars"),
        "dup_lines": rate("n_dup_lines", own("n_lines")), "repeat_words": rate("n_repeat_words", "n_words"), "distinct_words": rate(own("n_distinct"), "n_words"), "line_words": rate("n_words", own("n_lines")),
    })
    return rows.drop(own("words"), own("lines"), own("marks"), own("upper"), own("digits"), own("hashes"), own("sorted"), own("n_lines"), own("n_distinct"))


def _cuts(values: list[float], most: int = 64) -> list[float]:
    """Thresholds between neighbouring values, thinned evenly in rank."""
    u = sorted(set(values))
    mid = [(a + b) / 2 for a, b in zip(u, u[1:])]
    return mid if len(mid) <= most else [mid[i * len(mid) // most] for i in range(most)]


def _grow(rows: list[dict]) -> Rule:
    """Add the condition that gains most (in FOIL's measure) until only low rows are covered or nothing gains."""
    from math import log2

    rule: list[Condition] = []
    now = rows
    while any(not r["low"] for r in now) and len(rule) < 4:
        p0 = sum(r["low"] for r in now)
        base = log2(p0 / len(now))
        best, gain = None, 1e-9
        for f in FEATURES:
            ordered = sorted((r[f], r["low"]) for r in now)
            cuts = _cuts([v for v, _ in ordered])
            below_p = below_n = i = 0
            for c in cuts:
                while i < len(ordered) and ordered[i][0] < c:
                    below_p += ordered[i][1]
                    below_n += 1 - ordered[i][1]
                    i += 1
                for above, p, n in ((True, p0 - below_p, len(now) - p0 - below_n), (False, below_p, below_n)):
                    if p and (g := p * (log2(p / (p + n)) - base)) > gain:
                        best, gain = Condition(f, above, c), g
        if best is None:
            break
        rule.append(best)
        now = [r for r in now if best.holds(r)]
    return tuple(rule)


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int, int]:
    hit = [r["low"] for r in rows if all(c.holds(r) for c in rule)]
    p, n = sum(hit), len(hit) - sum(hit)
    return (p - n) / (p + n) if hit else -1.0, p, n


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drop last conditions while that is no worse on rows that the rule wasn't grown on."""
    best, worth = rule, _worth(rule, rows)
    for k in range(len(rule) - 1, 0, -1):
        w = _worth(rule[:k], rows)
        if w[0] > worth[0] or (w[0] == worth[0] and w[1] >= worth[1]):
            best, worth = rule[:k], w
    return best


def learn(rows: list[dict], precision: float = 0.95, least: int = 3) -> list[Rule]:
    """Rules that reject low rows, in order: rows have FEATURES, low (0 or 1) and part (0..2; part 2 prunes).

    A rule stays if at least `precision` of what it covers, of both parts, is low, and it covers `least` low rows; then
    what it covers goes and the next one is grown.
    """
    rules: list[Rule] = []
    left = sorted(rows, key=lambda r: r["key"])
    while True:
        grow, prune = [r for r in left if r["part"] < 2], [r for r in left if r["part"] == 2]
        if not any(r["low"] for r in grow):
            return rules
        rule = _grow(grow)
        if not rule:
            return rules
        pruned = _prune(rule, prune) if prune else rule
        for r in (pruned, rule):
            _, p, n = _worth(r, left)
            if p >= least and p >= precision * (p + n):
                rules.append(r)
                left = [x for x in left if not all(c.holds(x) for c in r)]
                break
        else:
            return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: 0 if no rule rejects, else the number of the first that does, from 1."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> list[Rule]:
    """The list learned from labelled documents; quality 0 is low. At most `sample` labels, first in the order of a hash of
    their id, are joined; their statistics, not texts, reach the driver. Of several texts of one id one is taken, by a hash.
    No labels, or none low: an empty list."""
    some = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("quality"))
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    stats = with_base(text_statistics(rows.withColumn("text_hash", F.xxhash64("text")))).select("doc_id", F.struct("text_hash", "quality", "base_failed", *FEATURES).alias("s"))
    stats = stats.groupBy("doc_id").agg(F.min("s").alias("s")).select("doc_id", "s.*").where(~F.col("base_failed"))
    key = F.xxhash64("doc_id", F.lit(8))
    got = stats.select(*FEATURES, (F.col("quality") == 0).cast("int").alias("low"), F.pmod(key, F.lit(3)).cast("int").alias("part"), key.alias("key"))
    return learn([r.asDict() for r in got.collect()])


def with_base(stats: DataFrame, *, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """Add base_failed: fewer than `least_words` words, or more than `most_repeats` percent of them in repeated windows."""
    return stats.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words")))


def judge(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """docs with their statistics, base_failed, rule (the first rule that rejects, or 0) and kept.

    Every row is judged by itself: repeated rows alike, null and empty texts fail the base.
    """
    out = with_base(text_statistics(docs, text=text)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
