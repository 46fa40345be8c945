"""Analytics over question logs and catalogue facets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T

DAY = 86_400


def unhit_frequency(log: DataFrame, *, question: str, ts: str, hit: str, order: str, days: int, now: Column | None = None) -> DataFrame:
    """question, n, last_order for questions without an answer in the last `days` whole days, most frequent first; ties by
    the latest row. `now` is the newest time of the log unless given, so results don't depend on the clock. A row counts if
    the whole days between it and now are at most `days`; future rows count. The newest time is a one-row aggregate."""
    if now is None:
        log = log.crossJoin(F.broadcast(log.agg(F.max(ts).alias("_now"))))
        now = F.col("_now")
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / (DAY * 1_000_000))
    recent = log.where((age <= days) & ~F.coalesce(F.col(hit), F.lit(False)))
    grouped = recent.groupBy(F.col(question).alias("question")).agg(F.count("*").alias("n"), F.max(order).alias("last_order"))
    return grouped.orderBy(F.desc("n"), F.desc("last_order"))


def log_filter(log: DataFrame, needle: str, columns: list[str], *, ts: str, limit: int = 300) -> DataFrame:
    """Rows whose columns, joined and lowered, contain the needle; newest first, rows without a time last; limit 1 to 2,000."""
    text = F.lower(F.concat_ws("\n", *columns))
    return log.where(text.contains(needle.lower())).orderBy(F.col(ts).desc_nulls_last(), *columns).limit(max(1, min(2000, limit)))


def log_page_filter(log: DataFrame, *, question: str, ts: str, hit: str, needle: str = "", source: str | None = None, only: str | None = None, start=None, end=None) -> DataFrame:
    """The log page's filter: text, source, hit or miss, from a day to the end of a day; None leaves a condition out."""
    keep = F.lower(F.col(question)).contains(needle.lower()) if needle else F.lit(True)
    if source is not None:
        keep = keep & (F.col("source") == source)
    if only in ("hit", "miss"):
        keep = keep & (F.coalesce(F.col(hit), F.lit(False)) == (only == "hit"))
    if start is not None:
        keep = keep & (F.col(ts) >= F.to_timestamp_ntz(F.lit(str(start))))
    if end is not None:
        keep = keep & (F.col(ts) < F.to_timestamp_ntz(F.lit(str(end))) + F.expr("interval 1 day"))
    return log.where(keep)


def group_by_question(log: DataFrame, *, question: Column, ts: str, hit: str) -> DataFrame:
    """question, n, hits, misses, first_ts, last_ts by normalised question, latest first."""
    is_hit = F.coalesce(F.col(hit), F.lit(False))
    return log.groupBy(question.alias("question")).agg(F.count("*").alias("n"), F.count_if(is_hit).alias("hits"), F.count_if(~is_hit).alias("misses"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).orderBy(F.desc("last_ts"), "question")


def report_filter(groups: DataFrame, *, needle: str = "", least: int = 1, hide: DataFrame | None = None, sort: str | None = None) -> DataFrame:
    """Report rows by text and least count, without questions that are done (an anti-join). Sorted by cnt_desc, cnt_asc or alpha
    if asked, questions by the collation of Japanese."""
    rows = groups.where((F.col("n") >= least) & F.lower("question").contains(needle.lower()))
    rows = rows if hide is None else rows.join(hide.select("question").distinct(), "question", "left_anti")
    name = F.collate("question", "ja")
    orders = {"cnt_desc": [F.desc("n"), name], "cnt_asc": [F.col("n"), name], "alpha": [name]}
    return rows.orderBy(*orders[sort]) if sort else rows


def top_tags(entries: DataFrame, *, tags: str, order: str, k: int = 8, default: tuple[str, ...] = ()) -> DataFrame:
    """tag, n for the k most frequent tags, ties by the first row that has it and the place in its list; the default tags with 0 for
    no tags at all."""
    placed = entries.select(F.posexplode(tags).alias("_p", "tag"), order).where("tag <> ''")
    counted = placed.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct(order, "_p")).alias("_first"))
    top = counted.orderBy(F.desc("n"), "_first").limit(k).select("tag", "n")
    if not default:
        return top
    rows = entries.sparkSession.createDataFrame([(t, 0) for t in default], "tag string, n long")
    none = counted.agg(F.count("*").alias("_k")).where("_k = 0")
    return top.unionByName(rows.crossJoin(F.broadcast(none)).select("tag", "n"))


def facets(matches: DataFrame, *, areas: str, tags: str, order: str, limit: int = 5) -> DataFrame:
    """kind, value, n: areas by count, then tags by count, together `limit` at most; ties by first row and the place in its list."""
    one = lambda col, kind, rank: matches.select(F.posexplode(col).alias("p", "value"), order).where("value is not null").groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct(order, "p")).alias("f")).select(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "value", "n", "f")
    both = one(areas, "area", 0).unionByName(one(tags, "tag", 1))
    return both.orderBy("rank", F.desc("n"), "f").limit(limit).select("kind", "value", "n")


def counts(**tables: DataFrame) -> DataFrame:
    """name, n for each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discriminative_tags(entries: DataFrame, *, group: str, tags: str, limit: int = 12, fall_back: bool = False) -> DataFrame:
    """group, tag: tags that some but not all tagged entries of a group have, in order, `limit` a group. A group of one
    entry keeps its tags, unless fall_back: then only a group without such tags gives all of its tags."""
    tagged = entries.where(F.size(tags) > 0)
    n = tagged.groupBy(group).agg(F.count("*").alias("_n"))
    per = tagged.select(group, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(group, "tag").agg(F.count("*").alias("_k")).join(n, group)
    apart = F.col("_k") < F.col("_n")
    if fall_back:
        per = per.withColumn("_any", F.max(apart.cast("int")).over(Window.partitionBy(group)))
        keep = apart | (F.col("_any") == 0)
    else:
        keep = apart | (F.col("_n") == 1)
    ranked = per.where(keep).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("tag")))
    return ranked.where(F.col("_r") <= limit).select(group, "tag")


def keyword_argmax(docs: DataFrame, keywords: list[str], *, text: str, key: str) -> DataFrame:
    """key, n of the document in which the keywords of two characters or more occur most often, not overlapping; ties by key; none for
    no occurrence. Texts and keywords are compared in NFKC, lower case and with single spaces."""
    body = T.title_key(F.col(text))
    keywords = [" ".join(unicodedata.normalize("NFKC", k).split()).lower() for k in keywords]
    keywords = [k for k in keywords if len(k) > 1]
    if not keywords:
        return docs.select(key, F.lit(0).cast("long").alias("n")).limit(0)
    each = [F.regexp_count(body, F.lit("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E")) for k in keywords]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return docs.select(key, F.coalesce(total, F.lit(0)).cast("long").alias("n")).where("n > 0").orderBy(F.desc("n"), key).limit(1)


def status_roll_up(states: DataFrame, *, state: str) -> DataFrame:
    """One row: error if any state is an error, else unknown if any is, else ready."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col(state) == s), F.lit(False))
    return states.agg(F.when(any_("error"), "error").when(any_("unknown"), "unknown").otherwise("ready").alias("overall"))


def week_overlap(events: DataFrame, day: Column, *, start: str, end: str) -> DataFrame:
    """Events that meet the ISO week of `day`; a missing start or end is the other one, without both there's no event."""
    s, e = F.coalesce(start, end).cast("date"), F.coalesce(end, start).cast("date")
    monday = F.date_trunc("week", day).cast("date")
    return events.where(~((e < monday) | (s > F.date_add(monday, 6))))


def estimated_bytes(files: DataFrame, *, size: str, margin: float = 0.08, more: int = 1_000_000) -> DataFrame:
    """Bytes of all files, and the sum with a share of it, whole bytes, and a fixed number on top."""
    return files.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).withColumn("needed", F.floor(F.col("bytes") * (1 + margin)).cast("long") + more)


def ranked_tags(tags: DataFrame, preferences: dict[str, list[str]], query: str, *, tag: str, order: str) -> DataFrame:
    """Tags by weight, then in their order: each word of the preferences that the query contains gives the tags of its list 100 less
    their place; weights add up."""
    weights: dict[str, int] = {}
    for word, listed in preferences.items():
        for i, t in enumerate(listed if word in (query or "") else []):
            weights[t] = weights.get(t, 0) + 100 - i
    weight = F.lit(0)
    for t, w in weights.items():
        weight = F.when(F.col(tag) == t, w).otherwise(weight)
    return tags.withColumn("weight", weight).orderBy(F.desc("weight"), order)


def retention(rows: DataFrame, *, group: str, ts: str, tie: str, newest: int) -> DataFrame:
    """The newest rows of each group, ties by the larger `tie`."""
    w = Window.partitionBy(group).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest).drop("_r")


def page(rows: DataFrame, *order: Column | str, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of the rows in order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
