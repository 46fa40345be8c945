"""Keyword search over catalogue entries: weighted fields, expanded tokens, cascades. Queries are rows, so many run at once.

Entries and queries meet through pieces of their texts (see matching), never as all pairs; what meets is then scored exactly,
and the best of a query are kept before they are shuffled. Entries are the side that grows: joins with them are by merging, since
Spark would send a table of small files to every task, by way of the driver, whatever its rows take in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.matching import containing
from fernglass.session import written


# fixed values: company marks that may stand before a name
COMPANY_MARKS = ("(株)", "（株）", "(有)", "（有）")


def _best(forms: Column, score) -> Column:
    """The largest score of an array's items; 0 for none."""
    return F.aggregate(F.coalesce(forms, F.expr("cast(array() as array<string>)")), F.lit(0.0), lambda a, f: F.greatest(a, score(f)))


def index_score(groups: Column, title: Column, title_forms: Column, aux: Column, tags: Column, areas: Column, short: Column) -> Column:
    """Score of an entry for token groups (array of arrays of alternatives, normalised): 0 if any group has no match.

    A title match counts 6.0 if equal, 5.0 at the start, 4.6 at the end, 4.2 inside, less 0.05 for each of at most 20 places
    for short queries, 0.3 more for an alias form, 0.5 at least. Only without one: other text 2.5 (for short queries less
    0.03 a place, 0.3 at least), a tag 3.0 (0.04, 0.4), an area 2.0 (0.03, 0.2). A short title adds up to 5.
    """

    def in_title(form: Column, token: Column, alias: bool) -> Column:
        at = T.find(form, token)
        base = F.when(form == token, 6.0).when(at == 0, 5.0).when(form.endswith(token), 4.6).otherwise(4.2)
        value = base - F.when(short, 0.05 * F.least(at, F.lit(20))).otherwise(0.0) + (0.3 if alias else 0.0)
        return F.when((at >= 0) & (token != ""), F.greatest(value, F.lit(0.5))).otherwise(0.0)

    def placed(form: Column, token: Column, top: float, per: float, far: int, least: float) -> Column:
        at = T.find(form, token)
        value = top - F.when(short, per * F.least(at, F.lit(far))).otherwise(0.0)
        return F.when((at >= 0) & (token != ""), F.greatest(value, F.lit(least))).otherwise(0.0)

    def one(token: Column) -> Column:
        by_title = F.greatest(in_title(title, token, False), _best(title_forms, lambda f: in_title(f, token, True)))
        other = F.greatest(_best(aux, lambda f: placed(f, token, 2.5, 0.03, 40, 0.3)), _best(tags, lambda f: placed(f, token, 3.0, 0.04, 40, 0.4)), _best(areas, lambda f: placed(f, token, 2.0, 0.03, 40, 0.2)))
        return F.when(by_title > 0, by_title).otherwise(other)

    each = F.transform(groups, lambda alternatives: F.aggregate(alternatives, F.lit(0.0), lambda a, t: F.greatest(a, one(t))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(groups) > 0) & ~F.exists(each, lambda x: x <= 0), total + F.greatest(F.lit(0.0), 5 - 0.05 * F.length(title))).otherwise(0.0)


def token_groups(query: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Groups of alternatives for a query: each variant's tokens are groups of their own (all must match), with synonyms."""
    tokens = F.array_distinct(F.flatten(F.transform(T.query_variants(query), lambda v: T.split_query(v))))
    if not synonyms:
        return F.transform(tokens, lambda t: F.array(t))
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.transform(tokens, lambda t: F.array_distinct(F.concat(F.array(t), F.coalesce(F.element_at(table, t), F.expr("cast(array() as array<string>)")))))


def best_of(scored: DataFrame, *order: Column, limit: int, per: str | list[str] = "qid") -> DataFrame:
    """The first `limit` rows of each query in the order, with their place `_r`. The bound is a number, so Spark keeps that many
    of each task's rows before the shuffle."""
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_r") <= limit)


def haystack(rows: DataFrame, *fields: str) -> Column:
    """All fields, and the items of lists, as lines of one text."""
    kinds = dict(rows.dtypes)
    return F.concat_ws("\n", *[F.array_join(f, "\n") if kinds[f].startswith("array") else F.col(f) for f in fields])


def candidates(entries: DataFrame, forms: DataFrame, *fields: str) -> DataFrame:
    """qid, ord of entries of which a field, or an item of a list, contains a form (qid, form) of the query."""
    hay = entries.select("ord", haystack(entries, *fields).alias("_hay"))
    return containing(hay, forms.select("qid", "form").distinct(), key="ord", text="_hay", form="form").select("qid", "ord").distinct()


def search_index(entries: DataFrame, queries: DataFrame, *, limit: int = 10, min_chars: int = 2, synonyms: dict[str, list[str]] | None = None, facets: bool = False) -> DataFrame:
    """qid, ord, score: the best entries (columns ord, title, title_forms, aux, tags, areas) of each query (qid, query). Queries
    shorter than min_chars give nothing; as short as it, five at most. Order: score, then title, then ord.

    With facets, queries have columns area and tag: where one isn't null or blank, an entry must have that very area or
    tag (normalised)."""
    norm = T.search_form
    listed = lambda c: F.transform(F.col(c), lambda x: norm(x))
    wanted = [norm(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("area", "tag")] if facets else [F.lit("").alias("_area"), F.lit("").alias("_tag")]
    q = queries.withColumn("_n", F.length(norm(F.col("query")))).where(F.col("_n") >= min_chars).select("qid", "_n", token_groups(F.col("query"), synonyms).alias("_g"), *wanted)
    fields = ["title", "tf", "aux", "tags", "areas"]
    e = entries.where("ord is not null").select("ord", norm(F.col("title")).alias("title"), listed("title_forms").alias("tf"), listed("aux").alias("aux"), listed("tags").alias("tags"), listed("areas").alias("areas"))
    # entries of one content have one score and differ by ord, so it is scored once, and its first `limit` ones are all that can count
    each = best_of(e, F.col("ord"), limit=limit, per=fields).groupBy(*fields).agg(F.array_sort(F.collect_list("ord")).alias("_ords"))
    each = written(each.withColumn("_c", F.monotonically_increasing_id()), "contents")
    groups = q.select("qid", F.posexplode("_g").alias("_p", "_a")).select("qid", "_p", F.explode("_a").alias("form"))
    hay = each.select("_c", haystack(each, *fields).alias("_hay"))
    met = written(containing(hay, groups.select("form").distinct(), key="_c", text="_hay", form="form").select("_c", "form"), "met")
    # every group must match: the one that fewest contents have brings a query's contents in, one that none has ends it
    sizes = groups.join(met.groupBy("form").agg(F.count("*").alias("_n")), "form", "left").groupBy("qid", "_p").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
    rarest = sizes.groupBy("qid").agg(F.min(F.struct("_n", "_p")).alias("_r")).where("_r._n > 0").select("qid", F.col("_r._p").alias("_p"))
    near = groups.join(rarest, ["qid", "_p"]).join(met, "form").select("qid", "_c").distinct()
    kept = near.join(each.hint("merge"), "_c").join(q, "qid").where(((F.col("_area") == "") | F.array_contains("areas", F.col("_area"))) & ((F.col("_tag") == "") | F.array_contains("tags", F.col("_tag"))))
    scored = kept.withColumn("score", index_score(F.col("_g"), F.col("title"), F.col("tf"), F.col("aux"), F.col("tags"), F.col("areas"), F.col("_n") <= min_chars)).where("score > 0")
    order = [F.desc("score"), F.col("title"), F.col("ord")]
    firsts = best_of(scored.select("qid", "_c", "score", "title", "_n", F.get("_ords", F.lit(0)).alias("ord")), *order, limit=limit).select("qid", "_c", "score", "title", "_n")
    best = best_of(firsts.join(each.select("_c", "_ords").hint("merge"), "_c").select("qid", F.explode("_ords").alias("ord"), "score", "title", "_n"), *order, limit=limit)
    return best.where((F.col("_r") <= 5) | (F.col("_n") > min_chars)).select("qid", "ord", "score")


def tourism_score(tokens: Column, title: Column, desc: Column, tags: Column, same_city: Column) -> Column:
    """For each token the largest of: 20 for the title itself, 12 at places 0 to 3 of it (13 after a company mark), 8 elsewhere
    in it; 4 in the description; 3 in a tag. Summed over tokens; 4 more for the query's own city."""

    def one(t: Column) -> Column:
        at = T.find(title, t)
        in_title = F.when(title == t, 20.0).when(at < 0, 0.0).when((at > 0) & (at <= 3) & F.substr(title, F.lit(1), at).isin(*COMPANY_MARKS), 13.0).when(at <= 3, 12.0).otherwise(8.0)
        return F.when(t == "", 0.0).otherwise(F.greatest(in_title, F.when(desc.contains(t), 4.0).otherwise(0.0), F.when(F.exists(tags, lambda g: g.contains(t)), 3.0).otherwise(0.0)))

    total = F.aggregate(tokens, F.lit(0.0), lambda a, t: a + one(t))
    return F.when(total > 0, total + F.when(same_city, 4.0).otherwise(0.0)).otherwise(0.0)


def expanded(tokens: Column, synonyms: Column) -> Column:
    """Tokens with the other forms that a map column names for them, each once, in order."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(synonyms, t), none)))))


def search_tourism(entries: DataFrame, queries: DataFrame, *, limit: int = 3, threshold: float = 8.0, synonyms: DataFrame | None = None) -> DataFrame:
    """qid, ord, score, direct: entries (ord, title, desc, tags, city, updated) by score, then newest, shortest title, title.
    direct says that the score decides an answer by itself. Of synonyms (form, other) each query takes those of its tokens."""
    norm = T.tourism_form
    q = queries.select("qid", F.col("city").alias("_city"), T.split_query(norm(F.col("query"), True), hyphen=False).alias("_t"))
    if synonyms is not None:
        pairs = q.select("qid", F.posexplode(F.array_distinct("_t")).alias("p", "form")).join(synonyms.select(norm(F.col("form")).alias("form"), norm(F.col("other")).alias("other")).where("other <> ''"), "form", "left")
        forms = pairs.select("qid", "p", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("k"), F.col("form").alias("t")), F.when(F.col("other").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("other").alias("t")))))).alias("x"))
        merged = forms.groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("p", "x.k", "x.t"))), lambda x: x["t"])).alias("_t"))
        q = q.drop("_t").join(merged, "qid")
    e = entries.select("ord", "city", "updated", norm(F.col("title")).alias("title"), norm(F.col("desc")).alias("desc"), F.transform("tags", lambda x: norm(x)).alias("tags"))
    near = candidates(e, q.select("qid", F.explode("_t").alias("form")), "title", "desc", "tags").join(e.hint("merge"), "ord").join(q, "qid")
    scored = near.withColumn("score", tourism_score(F.col("_t"), F.col("title"), F.col("desc"), F.col("tags"), F.coalesce(F.col("city") == F.col("_city"), F.lit(False)))).where("score > 0")
    best = best_of(scored.select("qid", "ord", "score", "updated", "title"), F.desc("score"), F.desc_nulls_last("updated"), F.length("title"), F.col("title"), F.col("ord"), limit=max(1, limit))
    return best.select("qid", "ord", "score", (F.col("score") >= threshold).alias("direct"))


def in_partition(entries: DataFrame, labels: list[str]) -> DataFrame:
    """Entries that may answer for a partition: area_checked says so and an area, normalised, is one of the partition's names."""
    names = F.array(*[T.tourism_form(F.lit(x)) for x in labels])
    return entries.where(T.truthy(F.col("area_checked"), True) & F.arrays_overlap(F.transform("areas", lambda a: T.tourism_form(a)), names))


def first_stage(near: DataFrame, entries: DataFrame, queries: DataFrame, stages: list[Column]) -> DataFrame:
    """qid, ord, stage: for each query the entries of the first stage, in order, that has any. `stages` are conditions over the
    columns of both; `near` (qid, ord) holds at least the pairs that meet one."""
    number = None
    for i, s in enumerate(stages):
        number = F.when(s, i) if number is None else number.when(s, i)
    hits = near.join(entries.hint("merge"), "ord").join(queries, "qid").withColumn("stage", number).where("stage is not null").select("qid", "ord", "stage")
    first = hits.groupBy("qid").agg(F.min("stage").alias("stage"))
    return hits.join(first, ["qid", "stage"]).select("qid", "ord", "stage")


def prioritised(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Title equal, title contains, any other field contains the whole query; the first bucket with hits wins. A blank query has
    no hits. Fields and query are compared in NFKC, lower case and with single spaces; tags, and areas, are one text each."""
    q, title = T.title_key(F.col("query")), T.title_key(F.col("title"))
    rest = F.concat_ws("\n", *[T.title_key(F.col(c)) for c in ("desc", "address")], *[T.title_key(F.array_join(c, " ")) for c in ("tags", "areas")])
    near = candidates(entries.select("ord", title.alias("t"), rest.alias("r")), queries.select("qid", q.alias("form")), "t", "r")
    return first_stage(near, entries, queries, [title == q, title.contains(q), rest.contains(q)])


def cascade(entries: DataFrame, queries: DataFrame, synonym_tags: DataFrame | None = None) -> DataFrame:
    """Title key equal; a haystack contains the query (both in the query's area, if it has one); title or description contains
    it anywhere; a tag that the query names, or a tag (qid, tag) that a synonym in it stands for, in the area."""
    queries = queries.withColumn("_q", T.title_key(F.col("query")))
    key = T.title_key(F.col("title"))
    in_area = F.col("area").isNull() | F.array_contains("areas", F.col("area"))
    hay = F.lower(F.concat_ws("\n", "title", "desc", "address", F.array_join("tags", "\n")))
    raw = F.col("title").contains(F.col("query")) | F.coalesce(F.col("desc").contains(F.col("query")), F.lit(False))
    tags = entries.select("ord", F.explode("tags").alias("tag"))
    named = containing(queries.select("qid", "_q"), tags.select(F.lower("tag").alias("form")).distinct(), key="qid", text="_q", form="form")
    by_tag = named.join(tags.withColumn("form", F.lower("tag")).hint("merge"), "form").select("qid", "ord")
    if synonym_tags is not None:
        by_tag = by_tag.unionByName(synonym_tags.join(tags.hint("merge"), "tag").select("qid", "ord"))
    by_tag = by_tag.distinct().withColumn("_tagged", F.lit(True))
    forms = queries.select("qid", F.explode(F.array_distinct(F.array("_q", F.col("query")))).alias("form"))
    texts = entries.select("ord", key.alias("t"), hay.alias("h"), "title", "desc")
    near = candidates(texts, forms, "t", "h", "title", "desc").unionByName(by_tag.select("qid", "ord")).distinct().join(by_tag, ["qid", "ord"], "left")
    q = F.col("_q")
    return first_stage(near, entries, queries, [(key == q) & in_area, hay.contains(q) & in_area, raw, F.coalesce("_tagged", F.lit(False)) & in_area])


def or_everything(rows: DataFrame, condition: Column, *, per: str) -> DataFrame:
    """Rows of each group that meet the condition, or all of its rows if none does. Whether any does is an aggregate that
    combines before the shuffle, so a group may hold any share of the rows; a null group is a group."""
    met = rows.withColumn("_m", F.coalesce(condition, F.lit(False)))
    groups = met.groupBy(F.col(per).alias("_g")).agg(F.bool_or("_m").alias("_any"))
    return met.join(groups, F.col(per).eqNullSafe(F.col("_g"))).where("_m or not _any").drop("_m", "_g", "_any")


def slot_search(entries: DataFrame, *, area: str | None = None, topic: str | None = None, price_range: str | None = None, tags: list[str] = (), weekday: str | None = None, limit: int = 5) -> DataFrame:
    """Entries (ord, area, topic, price_range, tags, closed, updated) by slots: the area contains the wanted one, so an entry
    without one goes; the wanted topic is part of the entry's, the price range is equal, where an entry without either stays;
    a tag is shared; the weekday isn't one of `closed`. By shared tags, then the newest (no time: as 2000-01-01), then ord."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    keep = F.lit(True)
    if area:
        keep = keep & F.lower(T.nfkc(text("area"))).contains(area.lower())
    if topic:
        keep = keep & ((text("topic") == "") | F.col("topic").contains(topic))
    if price_range:
        keep = keep & ((text("price_range") == "") | (F.col("price_range") == price_range))
    wanted = F.array(*[F.lit(t) for t in tags]) if tags else F.expr("cast(array() as array<string>)")
    shared = F.coalesce(F.size(F.array_intersect("tags", wanted)), F.lit(0))
    if tags:
        keep = keep & (shared > 0)
    if weekday:
        keep = keep & ~F.coalesce(F.array_contains("closed", weekday), F.lit(False))
    newest = F.coalesce(F.col("updated"), F.lit("2000-01-01"))
    return entries.where(keep).withColumn("shared", shared).orderBy(F.desc("shared"), newest.desc(), "ord").limit(limit)


def fragment_overlap(fragments: DataFrame, queries: DataFrame, *, k: int = 3, place: str | None = None) -> DataFrame:
    """qid, text, score: fragments (ord, text) that share tokens with the query (each query token counts, repeated ones again),
    by score, then length; equal texts once; if nothing is shared, the first k distinct ones with score 0. With `place`, a column
    of both sides, inside the query's place. Fragments without a token don't count.

    The k longest fragments with a query's rarest token are scored first. Tokens that together give less than their
    k-th best score bring no fragment in alone, so what everyone says meets no query; other fragments are found by the
    rest, and scored by their own tokens.
    """
    at = F.lit("") if place is None else F.col(place)
    tokens = F.array_distinct(T.fragment_tokens(F.col("text")))
    once = fragments.withColumn("_at", at).groupBy("_at", "text").agg(F.min("ord").alias("ord")).withColumn("_ws", tokens).where(F.size("_ws") > 0)
    once = written(once.select("_at", "ord", "text", F.length("text").alias("_l"), "_ws"), "fragments")
    own = queries.select("qid", at.alias("_at"), F.explode(T.fragment_tokens(F.col("query"))).alias("_w")).groupBy("qid", "_at", "_w").agg(F.count("*").alias("_k"))
    words = once.select("_at", "ord", "_l", F.explode("_ws").alias("_w")).join(own.select("_at", "_w").distinct(), ["_at", "_w"], "left_semi")
    words = written(words, "words")
    per = Window.partitionBy("qid")  # a query's tokens
    upwards = per.orderBy(F.desc("_df"), "_w").rowsBetween(Window.unboundedPreceding, 0)
    asked = own.join(words.groupBy("_at", "_w").agg(F.count("*").alias("_df")), ["_at", "_w"])
    asked = written(asked.withColumns({"_below": F.sum("_k").over(upwards), "_rare": F.row_number().over(per.orderBy("_df", F.desc("_w")))}), "asked")
    whole = asked.groupBy("qid").agg(F.collect_list(F.struct("_w", "_k")).alias("_asked"))

    def rated(met: DataFrame) -> DataFrame:
        both = met.join(once.drop("text"), ["_at", "ord"]).join(whole, "qid")
        return both.select("qid", "_at", "ord", "_l", F.aggregate("_asked", F.lit(0).cast("long"), lambda n, a: n + F.when(F.array_contains("_ws", a["_w"]), a["_k"]).otherwise(0)).alias("score"))

    seeds = words.join(asked.where("_rare = 1").select("qid", "_at", "_w"), ["_at", "_w"])
    seeds = best_of(seeds, F.desc("_l"), F.col("ord"), limit=k).select("qid", "_at", "ord")
    first = written(rated(seeds), "first")
    reach = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("_least"))
    may = asked.join(reach, "qid").where("_below >= _least").select("qid", "_at", "_w")
    met = words.join(may, ["_at", "_w"]).select("qid", "_at", "ord").distinct().join(first.select("qid", "ord"), ["qid", "ord"], "left_anti")
    scored = first.unionByName(rated(met))
    hits = best_of(scored, F.desc("score"), F.desc("_l"), F.col("ord"), limit=k).select("qid", "_at", "ord", "score")
    start = once.withColumn("_r", F.row_number().over(Window.partitionBy("_at").orderBy("ord"))).where(F.col("_r") <= k).select("_at", "ord") if place else once.orderBy("ord").limit(k).select("_at", "ord")
    others = queries.select("qid", at.alias("_at")).join(asked.select("qid").distinct(), "qid", "left_anti").join(F.broadcast(start) if place is None else start, "_at").select("qid", "_at", "ord", F.lit(0).cast("long").alias("score"))
    return hits.unionByName(others).join(once.select("_at", "ord", "text"), ["_at", "ord"]).select("qid", "text", "score")


def keyword_in_context(docs: DataFrame, words: list[str], *, key: str, text: str, window: int = 80, limit: int = 5) -> DataFrame:
    """key, snippet: `window` characters on both sides of each hit of a word of two characters or more, case ignored, trimmed;
    the first `limit` distinct ones in the order of key and place. No word, no rows.

    A hit's place is the length of all text and hits before it, so neighbouring hits each have their own snippet.
    """
    some = [w for w in words if len(w) > 1]
    if not some:
        return docs.select(key, F.lit("").alias("snippet")).limit(0)
    pattern = F.lit("(?iu)" + "|".join("\\Q" + w + "\\E" for w in some))
    body = F.regexp_replace(text, "\r\n?", "\n")
    rows = docs.select(key, body.alias("_t")).select(key, "_t", F.regexp_extract_all("_t", pattern, F.lit(0)).alias("_h")).where(F.size("_h") > 0)
    rows = rows.select(key, "_t", F.posexplode(F.arrays_zip("_h", F.slice(F.split("_t", pattern), F.lit(1), F.size("_h")).alias("_b"))).alias("p", "x"))
    rows = rows.select(key, "_t", "p", F.length(F.col("x")["_h"]).alias("hit"), F.length(F.col("x")["_b"]).alias("gap"))
    at = Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("hit") + F.col("gap")).over(at), F.lit(0)) + F.col("gap")
    left = F.greatest(start - window, F.lit(0))
    cut = rows.select(key, "p", T.strip(F.substr("_t", (left + 1).cast("int"), (start + F.col("hit") + window - left).cast("int"))).alias("snippet")).where("snippet <> ''")
    return cut.groupBy("snippet").agg(F.min(F.struct(key, "p")).alias("m")).orderBy("m").limit(limit).select(F.col(f"m.{key}").alias(key), "snippet")
