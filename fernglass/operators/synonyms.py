"""Synonym dictionaries: closure, detection in text, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.matching import containing
from fernglass.operators.search import best_of


def closure(groups: DataFrame, *, tag: str, aliases: str) -> DataFrame:
    """form, other: each form of a row with every other form of that row; rows unite, but nothing passes from row to row."""
    forms = groups.select(F.xxhash64(tag, aliases).alias("g"), F.explode(F.array_distinct(F.transform(F.concat(F.array(tag), aliases), lambda x: F.lower(F.trim(x))))).alias("form")).where(F.col("form") != "")
    return forms.alias("a").join(forms.alias("b"), F.expr("a.g = b.g and a.form <> b.form")).select(F.col("a.form").alias("form"), F.col("b.form").alias("other")).distinct()


def tags_in_text(questions: DataFrame, groups: DataFrame, *, key: str, text: str, tag: str, aliases: str) -> DataFrame:
    """key, tag of the tags of which a form occurs in the text (keys are distinct), both in NFKC, lower case and with single spaces;
    see matching."""
    forms = groups.select(F.col(tag).alias("tag"), F.explode(F.concat(F.array(tag), aliases)).alias("form")).withColumn("form", T.title_key(F.col("form"))).where(F.col("form") != "").distinct()
    return containing(questions.select(key, T.title_key(F.col(text)).alias("_t")), forms, key=key, text="_t", form="form").select(key, "tag").distinct()


def partition_of_text(questions: DataFrame, aliases: DataFrame, *, key: str, text: str, longest: bool = False) -> DataFrame:
    """key, label of the first alias in dictionary order (column ord) that a text contains, or of the longest one."""
    texts = questions.select(F.col(key).alias("_q"), F.lower(text).alias("_t"))
    hits = containing(texts, aliases.withColumn("_f", F.lower("alias")), key="_q", text="_t", form="_f").select(F.col("_q").alias(key), "label", "alias", "ord")
    best = F.min(F.struct((-F.length("alias")).alias("l"), "ord", "label")) if longest else F.min(F.struct("ord", "label"))
    return hits.groupBy(key).agg(best.alias("b")).select(key, F.col("b.label").alias("label"))


def missing(tags: DataFrame, groups: DataFrame, *, tag: str) -> DataFrame:
    """Tags that the dictionary has no aliases for."""
    return tags.select(tag).distinct().join(groups.where(F.size("aliases") > 0).select(tag).distinct(), tag, "left_anti")


def merge(base: DataFrame, incoming: DataFrame, *, tag: str, aliases: str) -> DataFrame:
    """Per tag the union of both alias lists, trimmed, sorted, without blanks."""
    rows = base.select(tag, aliases).unionByName(incoming.select(tag, aliases))
    forms = rows.select(tag, F.explode_outer(aliases).alias("a")).withColumn("a", F.trim("a"))
    return forms.groupBy(tag).agg(F.array_sort(F.collect_set(F.when(F.col("a") != "", F.col("a")))).alias(aliases))


def distinct_in_order(rows: DataFrame, *, key: str, order: str) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle."""
    first = rows.groupBy(F.lower(F.trim(key)).alias("_k")).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return first.select("r.*")


def rewrites(questions: DataFrame, groups: DataFrame, *, most: int = 4) -> DataFrame:
    """qid, place, rewrite: up to `most` other forms of questions (qid, question, keywords) by groups (ord, tag, aliases).

    First each keyword of the question gives way to the other forms of its groups; then all forms of a group to its tag; only
    if neither changes anything, each other form of a keyword stands before the other keywords. In the order of keywords,
    groups and forms; equal rewrites once."""
    q = questions.select("qid", F.trim("question").alias("base"), "keywords").where("base <> ''")
    g = groups.select("ord", "tag", F.concat(F.array("tag"), "aliases").alias("forms"))
    form = g.select("ord", F.explode("forms").alias("form"))
    met = containing(q.select("qid", "base"), form, key="qid", text="base", form="form").select("qid", "ord")
    named = q.select("qid", F.explode("keywords").alias("form")).join(form, "form").select("qid", "ord")
    both = met.unionByName(named).distinct().join(q, "qid").join(g, "ord")
    of = lambda token: F.array_contains(F.col("forms"), token)
    made = lambda stage, k, i, text: F.struct(F.lit(stage).alias("stage"), k.alias("k"), F.col("ord"), i.alias("i"), text.alias("text"))
    others = lambda t: F.filter("keywords", lambda k: k != t)
    swap = F.flatten(F.transform("keywords", lambda t, k: F.transform("forms", lambda a, i: F.when(of(t) & F.col("base").contains(t) & (a != t), made(1, k, i, F.replace(F.col("base"), t, a))))))
    folded = F.aggregate(F.filter("forms", lambda v: F.col("base").contains(v)), F.col("base"), lambda a, v: F.replace(a, v, F.col("tag")))
    apart = F.flatten(F.transform("keywords", lambda t, k: F.transform("forms", lambda a, i: F.when(of(t) & (a != t), made(3, k, i, F.trim(F.array_join(F.concat(F.array(a), others(t)), " ")))))))
    rows = both.select("qid", "base", F.explode(F.array_compact(F.concat(swap, F.array(made(2, F.lit(0), F.lit(0), folded)), apart))).alias("x"))
    rows = rows.where("x.text <> '' and (x.stage = 3 or x.text <> base)")
    # in stage 2 groups come before all else, in the others after the keyword
    once = rows.groupBy("qid", F.col("x.text").alias("rewrite")).agg(F.min(F.struct("x.stage", "x.k", "x.ord", "x.i")).alias("at"))
    best = best_of(once, F.col("at"), limit=most).select("qid", F.col("_r").cast("long").alias("place"), "rewrite", F.col("at.stage").alias("stage"))
    lone = best.groupBy("qid").agg(F.min("stage").alias("least"))
    return best.join(lone, "qid").where("stage < 3 or least = 3").select("qid", "place", "rewrite")
