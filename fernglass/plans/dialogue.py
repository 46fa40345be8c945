"""Dialogues that narrow a search: a base query, filters that later turns add, and what each turn is answered with.

Whether a turn still belongs to a search depends on what earlier turns found. All searches that a conversation can come to are
asked at once, before it is known which count; a fold over the turns then reads their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.search import best_of
from fernglass.session import written
from fernglass.streaming.guards import carried


def filter_command(text: Column) -> Column:
    """(kind, value) of `@area:x` or `@tag:x`, case and spaces around the kind aside; null for other texts."""
    pattern = r"(?is)^@\s*(area|tag)\s*:\s*(\S.*)$"
    t = T.strip(text)
    return F.when(t.rlike(pattern), F.struct(F.lower(F.regexp_extract(t, pattern, 1)).alias("kind"), F.regexp_extract(t, pattern, 2).alias("value")))


def _step(base, command, n, found):
    """The base turn after a turn, and `kind:base` of its answer: base -1 for a search by the turn's own text."""
    if command and base is not None:
        n = next(x["n"] for x in found if x["b"] == base)
        if n == 1:
            return None, f"detail:{base}"
        return base, f"{'choices' if n else 'no_hit'}:{base}"
    return "own", f"{'no_hit' if not n else 'detail' if n == 1 else 'choices'}:-1"


def replies(turns: DataFrame, entries: DataFrame, find: Callable[[DataFrame], DataFrame], *, conv: str, turn: str, text: str, least: int = 2, previews: int = 3, options: int = 5) -> DataFrame:
    """conv, turn, kind, query, area, tag, n, first, preview, options of each turn (whole numbers, distinct in a conversation).

    A turn that isn't a filter command, or is one without a search to narrow, starts a search by its own text; texts of fewer
    than `least` characters find nothing. Several matches are choices: the search is kept as the base of later filters.
    One match is a detail, with which a search ends; no match ends a new search and leaves a narrowed one as it is.
    A filter takes the place of the earlier one of its kind. `find` gives qid, ord of searches (qid, query, area, tag), of
    all conversations at once; `first` is the entry of a detail. Choices have the first titles with areas and 60
    characters of their description, and as options the areas, then the tags, that most matches have.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), T.strip(F.coalesce(F.col(text), F.lit(""))).alias("query"), filter_command(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    order = Window.partitionBy("conv").orderBy("turn")
    plain = F.col("c").isNull().cast("int")
    rows = written(rows.withColumn("part", F.sum(plain).over(order.rowsBetween(Window.unboundedPreceding, 0))), "turns")
    none = F.lit(None).cast("string")
    key = lambda q, a, t: F.to_json(F.struct(q.alias("q"), a.alias("a"), t.alias("t")))
    alone = rows.withColumn("key", key(F.col("query"), none, none))

    def counted(asked: DataFrame) -> DataFrame:
        some = asked.where(F.length(T.search_form(F.col("query"))) >= least).select("key", "query", "area", "tag").distinct()
        return written(find(some.select(F.col("key").alias("qid"), "query", "area", "tag")).select(F.col("qid").alias("key"), "ord").distinct(), "found")

    own = counted(alone.select("key", "query", none.alias("area"), none.alias("tag")))
    numbers = own.groupBy("key").agg(F.count("*").alias("n"))
    alone = written(alone.join(numbers, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))), "alone")
    # a base and the commands of its part after it: between them is no plain turn
    bases = alone.where("n > 1").select("conv", "part", F.col("turn").alias("b"), "query")
    after = alone.where("c is not null").select("conv", "part", "turn", "c").join(bases, ["conv", "part"]).where("turn > b")
    so_far = Window.partitionBy("conv", "b").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(F.col("c.kind") == kind, F.col("c.value")), ignorenulls=True).over(so_far).alias(kind)
    narrowed = after.select("conv", "turn", "b", "query", last("area"), last("tag")).withColumn("key", key(F.col("query"), F.col("area"), F.col("tag")))
    narrowed = written(narrowed, "narrowed")
    more = counted(narrowed)
    narrowed_n = narrowed.join(more.groupBy("key").agg(F.count("*").alias("n")), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = narrowed_n.groupBy("conv", "turn").agg(F.collect_list(F.struct("b", "n")).alias("found"))
    read = alone.join(per, ["conv", "turn"], "left").select("conv", "turn", F.col("c").isNotNull().alias("command"), "n", "found")

    def step(base, at, command, n, found):
        base, said = _step(base, command, n, found or [])
        return (at if n > 1 else None) if base == "own" else base, said

    told = carried(read, ["conv"], ["turn"], ["turn", "command", "n", "found"], _Held(step), start=lambda: _NONE, out="said", kind="string")
    told = told.select("conv", "turn", F.split("said", ":")[0].alias("kind"), F.split("said", ":")[1].cast("long").alias("b"))
    used = alone.select("conv", "turn", F.lit(-1).cast("long").alias("b"), "query", none.alias("area"), none.alias("tag"), "key").unionByName(narrowed.select("conv", "turn", "b", "query", "area", "tag", "key"))
    told = written(told.join(used, ["conv", "turn", "b"]), "told")
    # what a search found is told once for all turns that say it
    found = own.unionByName(more).distinct().join(told.select("key").distinct(), "key", "left_semi")
    matches = written(found.join(entries.select("ord", "title", "desc", "areas", "tags").hint("merge"), "ord"), "matches")
    per_key = written(matches.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first")), "counted")
    several = matches.join(per_key.where("n > 1").select("key"), "key", "left_semi")
    snippet = F.regexp_replace(F.substr(T.squeeze(F.coalesce("desc", F.lit(""))), F.lit(1), F.lit(60)), "[、。・ ]+$", "")
    areas = F.array_join("areas", " / ")
    line = F.concat(F.lit("- "), F.trim("title"), F.when(areas != "", F.concat(F.lit("（"), areas, F.lit("）"))).otherwise(""), F.when(snippet != "", F.concat(F.lit("："), snippet)).otherwise(""))
    in_order = lambda rows, value, by: rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("v")))), lambda x: x["v"]).alias("all"))
    shown = in_order(best_of(several, F.col("ord"), limit=previews, per="key"), line, "ord").select("key", F.array_join("all", "\n").alias("preview"))
    named = lambda c, kind: F.transform(c, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("i")))
    values = several.select("key", "ord", F.explode(F.concat(named("areas", "area"), named("tags", "tag"))).alias("v"))
    ranked = best_of(values.groupBy("key", "v.kind", "v.value").agg(F.count("*").alias("k"), F.min(F.struct("ord", "v.i")).alias("f")), F.col("kind"), F.desc("k"), F.col("f"), limit=options, per="key")
    listed = in_order(ranked, F.concat(F.lit("@"), "kind", F.lit(":"), "value"), "_r").select("key", F.array_join("all", "|").alias("options"))
    both = told.join(written(per_key.join(shown, "key", "left").join(listed, "key", "left"), "said"), "key", "left")
    return both.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "kind", "query", "area", "tag", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("kind") == "detail", F.col("first")).alias("first"), F.coalesce("preview", F.lit("")).alias("preview"), F.coalesce("options", F.lit("")).alias("options"))


class _Held:
    """A fold whose state may be null: `carried` starts a key anew where there is no state."""

    def __init__(self, step: Callable):
        self.step = step

    def __call__(self, state, *values):
        base, out = self.step(state[0], *values)
        return (base,), out


_NONE = (None,)
