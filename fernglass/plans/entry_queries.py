"""Queries over catalogue entries: merging, edits, synonyms, search, distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import catalogue as C
from fernglass.operators import nearby, search
from fernglass.operators import synonyms as S
from fernglass.plans import routing
from fernglass.plans.views import ENTRIES, entries, queries
from fernglass.session import numbered, table

_joined = lambda c: F.array_join(c, "|")


def dedupe_merge(spark, d):
    m = C.merge_duplicates(entries(spark, d), title="title", order="ord", modal=["desc"], lists=["tags", "areas"], first=["price"])
    return m.select("title_key", "ord", "n", F.col("desc").alias("descr"), _joined("tags").alias("tags"), _joined("areas").alias("areas"), "price")


def dedupe_stats(spark, d):
    return C.merge_statistics(entries(spark, d), title="title")


def duplicate_groups(spark, d):
    return C.duplicate_groups(entries(spark, d), title="title", order="ord")


def mode_or_longest(spark, d):
    e = entries(spark, d).withColumn("v", F.when(F.col("ord") % 3 == 0, F.upper("title")).when(F.col("ord") % 3 == 1, F.concat(F.lit("  "), F.replace(F.col("title"), F.lit(" "), F.lit("  ")))).otherwise(F.col("title")))
    return C.mode_or_longest(e, key="category", value="v", order="ord")


def best_url(spark, d):
    hosts = F.array(*[F.lit(x) for x in ("", "?from=g.page", "?to=g.co/kgs", "?x=GOOGLE.com/MAPS", "/maps", " ")])
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 10).alias("k"), F.concat(F.when(F.col("page_id") % 4 == 0, F.substr("url", F.lit(9))).otherwise(F.col("url")), F.element_at(hosts, (F.col("page_id") % 6 + 1).cast("int"))).alias("url"))
    return C.best_url(p, key="k", url="url", order="page_id")


def merge_maps(spark, d):
    e = entries(spark, d).select("category", "ord", F.create_map(F.lit("brand"), F.col("tags")[0], F.lit("size"), F.when(F.col("updated") > 25, "large").otherwise("small"), F.lit("note"), F.when(F.col("ord") < 0, "never")).alias("extras"))
    return C.merge_maps(e, key="category", value="extras", order="ord").select("category", F.array_join(F.transform(F.map_entries("extras"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("extras"))


def bulk_merge(spark, d):
    """Every part is edited (titles in capitals), large ones are deleted, every supplier is added."""
    base = entries(spark, d).select(F.col("ord").alias("id"), "title", "category")
    edits = entries(spark, d).select(F.col("ord").alias("id"), F.upper("title").alias("title"), F.lit(None).cast("string").alias("category"), (F.col("updated") > 45).alias("deleted"), F.lit(0).cast("long").alias("ord"))
    new = table(spark, d, "supplier").select(F.lit(None).cast("long").alias("id"), F.col("s_name").alias("title"), F.lit("new").alias("category"), F.lit(False).alias("deleted"), F.col("s_suppkey").alias("ord"))
    return C.bulk_merge(base, edits.unionByName(new), id="id", columns=["title", "category"])


def edit_conflicts(spark, d):
    base = entries(spark, d).select(F.col("ord").alias("id"))
    edits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).unionByName(table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id")))
    return C.edit_conflicts(base, edits, id="id")


def validate_entries(spark, d):
    e = entries(spark, d).select("ord", F.when(F.col("ord") % 13 == 0, "  ").otherwise(F.col("title")).alias("title"), F.when(F.col("ord") % 17 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.col("areas")).alias("areas"))
    return C.violations(e, order="ord")


def normalise_entries(spark, d):
    raw = entries(spark, d).select("ord", F.concat(F.lit(" "), "title").alias("title"), F.concat_ws(" ,\n", "tags").alias("tags"), F.when(F.col("ord") % 2 == 0, F.col("category")).alias("category"), F.when(F.col("ord") % 3 == 0, "Yes").otherwise("0").alias("area_checked"))
    return C.normalise_entries(raw).select("ord", "title", _joined("tags").alias("tags"), "category", "area_checked")


def state_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("reason"), "event_id")
    return C.upsert(e.where("reason <> 'click'"), e.where("reason = 'click'"), key="user_id", ts="event_id")


#: Synonyms that questions are looked up in.
_SYN = [("ring", ["band", "loop"]), ("bolt", ["screw", "ring "]), ("widget", ["gadget"]), ("red", [])]
_SYN_SQL = "s AS (SELECT * FROM (VALUES ('ring', ['band', 'loop']), ('bolt', ['screw', 'ring ']), ('widget', ['gadget']), ('red', CAST([] AS VARCHAR[]))) t(tag, aliases))"


def _syn(spark):
    return spark.createDataFrame(_SYN, "tag string, aliases array<string>")


def _brands_of(spark, d, larger):
    """Each category with the brands of its parts above or up to size 25, as a dictionary."""
    e = entries(spark, d).where((F.col("updated") > 25) == F.lit(larger))
    return e.groupBy(F.col("category").alias("tag")).agg(F.collect_set(F.concat(F.lit(" "), F.col("tags")[0])).alias("aliases"))


def synonym_closure(spark, d):
    return S.closure(_brands_of(spark, d, True), tag="tag", aliases="aliases")


def tags_by_synonym(spark, d):
    return S.tags_in_text(entries(spark, d), _syn(spark), key="ord", text="title", tag="tag", aliases="aliases")


def missing_synonyms(spark, d):
    words = entries(spark, d).select(F.explode(F.split("title", " ")).alias("tag"))
    return S.missing(words, _syn(spark), tag="tag")


def merge_synonyms(spark, d):
    return S.merge(_brands_of(spark, d, True), _brands_of(spark, d, False), tag="tag", aliases="aliases").select("tag", _joined("aliases").alias("aliases"))


_ALIASES = [("ring", "r", 2), ("small ring", "sr", 3), ("RED", "c", 1)]


def partition_detect(spark, d):
    return S.partition_of_text(entries(spark, d).select("title").distinct(), spark.createDataFrame(_ALIASES, "alias string, label string, ord int"), key="title", text="title")


def partition_detect_longest(spark, d):
    return S.partition_of_text(entries(spark, d).select("title").distinct(), spark.createDataFrame(_ALIASES, "alias string, label string, ord int"), key="title", text="title", longest=True)


def distinct_in_order(spark, d):
    return S.distinct_in_order(entries(spark, d), key="title", order="ord").select("ord", "title")


def _brands(spark, d, kind):
    return entries(spark, d).where(F.col("category") == kind).select(F.col("tags")[0].alias("brand"), (F.col("ord") % 4).alias("k"))


def set_union(spark, d):
    return _brands(spark, d, "SMALL").union(_brands(spark, d, "PROMO")).distinct()


def set_intersect(spark, d):
    return _brands(spark, d, "SMALL").intersect(_brands(spark, d, "PROMO"))


def set_except(spark, d):
    return _brands(spark, d, "SMALL").exceptAll(_brands(spark, d, "PROMO"))


_WORDS = [(1, "ring"), (2, "red"), (3, "small ring"), (4, "zz"), (5, "e"), (6, "promo"), (7, "br"), (8, "ar"), (9, "brand"), (10, "#1"), (11, "rand")]


def entry_index_search(spark, d):
    none = F.expr("cast(array() as array<string>)")
    e = entries(spark, d).withColumn("title_forms", none).withColumn("aux", F.array("desc"))
    return search.search_index(e, queries(spark, _WORDS), limit=10).select("qid", "ord", F.round("score", 6).alias("score"))


def tourism_search(spark, d):
    q = spark.createDataFrame([(1, "ring", None), (2, "small", "area2"), (3, "promo", None)], "qid long, query string, city string")
    return search.search_tourism(entries(spark, d), q, limit=3)


def prioritized_search(spark, d):
    return search.prioritised(entries(spark, d), queries(spark, [(1, "small ring"), (2, "ring"), (3, "promo"), (4, "nothing")])).select("qid", "ord", F.col("stage").cast("long").alias("stage"))


def cascade_search(spark, d):
    q = spark.createDataFrame([(1, "Small Ring", "area1"), (2, "ring", "area2"), (3, "PROMO sale", None), (4, "red", "nowhere")], "qid long, query string, area string")
    return search.cascade(entries(spark, d), q).select("qid", "ord", F.col("stage").cast("long").alias("stage"))


def facet_search(spark, d):
    none = F.expr("cast(array() as array<string>)")
    e = entries(spark, d).withColumn("title_forms", none).withColumn("aux", F.array("desc"))
    q = spark.createDataFrame([(1, "ring", "area1", None), (2, "ring", " AREA2", "promo"), (3, "small", "area", None), (4, "bolt", "", "Brand#12")], "qid long, query string, area string, tag string")
    return search.search_index(e, q, limit=10, facets=True).select("qid", "ord", F.round("score", 6).alias("score"))


def partition_entries(spark, d):
    e = entries(spark, d).withColumn("area_checked", F.element_at(F.array(*[F.lit(x) for x in ("yes", "0", "ok", "")]), (F.col("updated") % 4 + 1).cast("int")))
    return search.in_partition(e, ["Area1", "area 3"]).select("ord")


def tourism_synonyms(spark, d):
    q = spark.createDataFrame([(1, "band", None), (2, "gadget small", "area2")], "qid long, query string, city string")
    return search.search_tourism(entries(spark, d), q, limit=5, synonyms=S.closure(_syn(spark), tag="tag", aliases="aliases"))


def query_rewrites(spark, d):
    """All questions of the conversations, with the words that the dictionary below knows."""
    g = spark.createDataFrame([(1, "the", ["this", "that"]), (2, "of", ["from"]), (3, "que", ["quoi", "qui"]), (4, "und", ["sowie"])], "ord int, tag string, aliases array<string>")
    q = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"), T.question_keywords(F.col("text")).alias("keywords"))
    return S.rewrites(q, g).select("qid", "place", F.md5("rewrite").alias("md5"))


def fuzzy_names(spark, d):
    """Each supplier's name, written a little differently, beside all names."""
    s = table(spark, d, "supplier")
    return C.close_names(s.select("s_suppkey", F.concat(F.substr("s_name", F.lit(1), F.lit(6)), F.lit("x"), F.substr("s_name", F.lit(8))).alias("t")), s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")), key="s_suppkey", text="t", name="name")


def title_lookup(spark, d):
    q = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.concat(F.lit(" "), F.upper("p_name")).alias("line"))
    got = C.by_title(q, entries(spark, d).select("ord", "title", "category"), key="k", line="line", title="title", order="ord")
    return got.select("k.l_orderkey", "k.l_linenumber", "ord", "category")


def vector_lookup(spark, d):
    """The vector of each document that has one: an equi-join of two tables by their key."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").cast("long").alias("size"))
    return table(spark, d, "documents").select("doc_id", "lang").join(v, "doc_id")


def import_entries(spark, d):
    e = entries(spark, d).select("ord", "title", "category")
    new = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("ord"), F.concat(F.lit(" "), "s_name").alias("title"), F.lit(" ").alias("category"))
    return C.imported(e, new)


def queue_take(spark, d):
    """The next items of a queue that was kept, those after the first five, without what has been done since."""
    done = table(spark, d, "part").where("p_size % 5 = 0 and p_retailprice < 950").select(F.concat(F.lit(" "), F.upper("p_name")).alias("title"))
    targets = entries(spark, d).select("title")
    kept = numbered(targets.distinct(), F.col("title"), name="place").where("place > 5")
    return C.without_done(C.work_queue(kept, targets, key="title", take=100), done, key="title")


def manifest_prune(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    changes = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("done").alias("o_orderstatus"))
    return C.pruned(C.updated(o, changes, key="o_orderkey"), ts="o_orderdate", tie="o_orderkey", keep=200).select("o_orderkey", "o_orderstatus")


def slot_search(spark, d):
    e = entries(spark, d).select(
        "ord", F.when(F.col("updated") % 6 > 0, F.col("city")).alias("area"), F.when(F.col("updated") % 4 > 0, F.concat(F.lower("category"), F.lit(" things"))).alias("topic"),
        F.when(F.col("price") < 950, "low").when(F.col("price") < 1200, "").otherwise("high").alias("price_range"), "tags",
        F.when(F.col("updated") % 7 == 0, F.array(F.lit("mon"), F.lit("tue"))).alias("closed"), F.when(F.col("updated") > 10, F.concat(F.lit("20"), F.col("updated").cast("string"), F.lit("-01-01"))).alias("updated"),
    )
    return search.slot_search(e, area="AREA1", topic="promo", price_range="low", tags=["PROMO", "SMALL", "Brand#2"], weekday="tue", limit=5).select("ord", F.col("shared").cast("long").alias("shared"))


def progressive_filter(spark, d):
    return search.or_everything(entries(spark, d), F.col("title").contains("ring") & (F.col("updated") > 45), per="city").select("city", "ord")


def fragment_overlap(spark, d):
    f = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return search.fragment_overlap(f, queries(spark, [(1, "the the that on"), (2, "zzz"), (3, "and")]), k=3).select("qid", F.md5("text").alias("md5"), F.col("score").cast("long").alias("score"))


def kwic(spark, d):
    return search.keyword_in_context(table(spark, d, "documents"), ["clown", "idiot", "a"], key="doc_id", text="text", limit=50).select("doc_id", F.md5("snippet").alias("md5"))


def nearby_places(spark, d):
    """Centres on the globe, and in larger tables some whose latitude isn't."""
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cid"), (32.5 + F.col("s_suppkey") / 10).alias("clat"), (128.5 + F.col("s_suppkey") / 7).alias("clng"))
    return nearby.within_radius(entries(spark, d), c, radius_m=9000, limit=10)


def nearby_around_the_globe(spark, d):
    """Places and centres on both sides of 180 degrees and close to a pole, of two categories."""
    e = entries(spark, d).withColumn("lng", F.col("lng") + F.when(F.col("lng") > 129, 50).otherwise(-308)).withColumn("lat", F.when(F.col("ord") % 2 == 0, F.col("lat") + 56.9).otherwise(F.col("lat")))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cid"), F.when(F.col("s_suppkey") % 2 == 0, 89.9).otherwise(33.0).alias("clat"), F.when(F.col("s_suppkey") % 3 == 0, 179.99).otherwise(-179.99).alias("clng"))
    return nearby.within_radius(e, c, radius_m=60_000, limit=10, categories=["PROMO", "SMALL"])


def responder_states(spark, d):
    e = entries(spark, d)
    q = queries(spark, [(1, "small ring"), (2, "nothing"), (3, "bolt")])
    hits = search.prioritised(e, q).join(e.select("ord", "title", "areas", "tags").hint("merge"), "ord")
    return routing.respond(hits, q)


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_merge, dedupe_stats, duplicate_groups, mode_or_longest, best_url, merge_maps, bulk_merge, edit_conflicts, validate_entries, normalise_entries, state_upsert, synonym_closure, tags_by_synonym, missing_synonyms, merge_synonyms,
        partition_detect, partition_detect_longest, distinct_in_order, set_union, set_intersect, set_except, entry_index_search, facet_search, partition_entries, tourism_search, tourism_synonyms, query_rewrites, fuzzy_names, title_lookup,
        vector_lookup, import_entries, queue_take, manifest_prune, prioritized_search, cascade_search, slot_search, progressive_filter, fragment_overlap, kwic, nearby_places, nearby_around_the_globe, responder_states,
    )
}

_ALIAS_SQL = "a AS (SELECT * FROM (VALUES ('ring', 'r', 2), ('small ring', 'sr', 3), ('red', 'c', 1)) t(alias, label, ord)), h AS (SELECT DISTINCT title, alias, label, a.ord FROM e JOIN a ON contains(lower(title), alias))"
_BRANDS = "b AS (SELECT category, tags[1] AS brand, ord % 4 AS k FROM e)"
_PRIO = "q AS (SELECT * FROM (VALUES (1::BIGINT, 'small ring'), (2, 'ring'), (3, 'promo'), (4, 'nothing'), (5, 'bolt')) t(qid, query)), h AS (SELECT qid, ord, title, CASE WHEN lower(title) = query THEN 0 WHEN contains(lower(title), query) THEN 1 WHEN contains(lower(descr || chr(10) || list_aggregate(tags, 'string_agg', chr(10)) || chr(10) || list_aggregate(areas, 'string_agg', chr(10))), query) THEN 2 END AS stage FROM e, q), w AS (SELECT * FROM h WHERE stage IS NOT NULL QUALIFY stage = min(stage) OVER (PARTITION BY qid))"

ORACLE_SQL = {
    "dedupe_merge": f"""WITH {ENTRIES}, f AS (SELECT title, descr AS norm, count(*) AS n, min(ord) AS f, arg_min(descr, ord) AS raw FROM e GROUP BY 1, 2),
        m AS (SELECT title, raw FROM f QUALIFY row_number() OVER (PARTITION BY title ORDER BY n DESC, length(norm) DESC, f) = 1),
        t AS (SELECT title, tag, min(ord * 2 + p) AS o FROM (SELECT title, ord, unnest(tags) AS tag, unnest([0, 1]) AS p FROM e) GROUP BY title, tag),
        ts AS (SELECT title, string_agg(tag, '|' ORDER BY o) AS tags FROM t GROUP BY title), a AS (SELECT title, area, min(ord) AS o FROM (SELECT title, ord, unnest(areas) AS area FROM e) GROUP BY 1, 2), s AS (SELECT title, string_agg(area, '|' ORDER BY o) AS areas FROM a GROUP BY title)
        SELECT e.title AS title_key, min(ord) AS ord, count(*) AS n, any_value(m.raw) AS descr, any_value(ts.tags) AS tags, any_value(s.areas) AS areas, arg_min(price, ord) AS price FROM e JOIN m ON m.title = e.title JOIN ts ON ts.title = e.title JOIN s ON s.title = e.title GROUP BY e.title""",
    "dedupe_stats": "WITH g AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT count(*) FILTER (WHERE n > 1) AS merged_groups, CAST(sum(n - 1) AS BIGINT) AS removed, count(*) AS total_after FROM g",
    "duplicate_groups": "SELECT p_name AS title_key, count(*) AS n, min(p_partkey) AS first_ord FROM part GROUP BY 1 HAVING count(*) > 1",
    "mode_or_longest": rf"""WITH {ENTRIES}, v AS (SELECT category, ord, CASE ord % 3 WHEN 0 THEN upper(title) WHEN 1 THEN replace(title, ' ', '  ') ELSE title END AS raw FROM e), f AS (SELECT category, regexp_replace(raw, '\s+', ' ', 'g') AS norm, count(*) AS n, min(ord) AS f FROM v GROUP BY 1, 2),
        m AS (SELECT category, norm FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, length(norm) DESC, f) = 1)
        SELECT v.category, raw AS v FROM v JOIN m ON m.category = v.category AND m.norm = regexp_replace(raw, '\s+', ' ', 'g') QUALIFY row_number() OVER (PARTITION BY v.category ORDER BY length(raw) DESC, ord) = 1""",
    "best_url": """WITH p AS (SELECT page_id, page_id % 10 AS k, trim(CASE WHEN page_id % 4 = 0 THEN substr(url, 9) ELSE url END || ['', '?from=g.page', '?to=g.co/kgs', '?x=GOOGLE.com/MAPS', '/maps', ' '][page_id % 6 + 1]) AS url FROM pages),
        s AS (SELECT *, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN 2 ELSE 0 END + CASE WHEN contains(url, 'google.com/maps') OR contains(url, 'goo.gl/maps') OR contains(url, 'maps.app.goo.gl') OR contains(url, 'g.page') OR contains(url, 'g.co/kgs') THEN 10 ELSE 0 END
          + CASE WHEN contains(url, 'maps') THEN 2 ELSE 0 END + CASE WHEN length(url) >= 20 THEN 1 ELSE 0 END AS score FROM p) SELECT k, url FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, length(url) DESC, page_id) = 1""",
    "merge_maps": f"""WITH {ENTRIES}, v AS (SELECT category, ord, 'brand' AS k, tags[1] AS v FROM e UNION ALL SELECT category, ord, 'size', CASE WHEN updated > 25 THEN 'large' ELSE 'small' END FROM e), f AS (SELECT category, k, v, count(*) AS n, min(ord) AS f FROM v GROUP BY 1, 2, 3),
        m AS (SELECT category, k, v FROM f QUALIFY row_number() OVER (PARTITION BY category, k ORDER BY n DESC, length(v) DESC, f) = 1) SELECT category, string_agg(k || '=' || v, '|' ORDER BY k) AS extras FROM m GROUP BY category""",
    "bulk_merge": """SELECT p_partkey AS id, upper(p_name) AS title, p_type AS category FROM part WHERE p_size <= 45
        UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey), s_name, 'new' FROM supplier""",
    "edit_conflicts": "SELECT l_partkey AS id, 'duplicate' AS problem FROM lineitem GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT -s_suppkey - 1, 'unknown' FROM supplier UNION ALL SELECT DISTINCT l_partkey, 'unknown' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)",
    "validate_entries": "SELECT p_partkey AS ord, 'title' AS problem FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey, 'areas' FROM part WHERE p_partkey % 17 = 0",
    "normalise_entries": f"WITH {ENTRIES} SELECT ord, title, tags[1] || '|' || tags[2] AS tags, CASE WHEN ord % 2 = 0 THEN category ELSE 'other' END AS category, ord % 3 = 0 AS area_checked FROM e",
    "state_upsert": "SELECT user_id, arg_max(event_type, event_id) AS reason, max(event_id) AS event_id FROM events GROUP BY user_id",
    "synonym_closure": "WITH g AS (SELECT DISTINCT lower(p_type) AS g, lower(p_brand) AS form FROM part WHERE p_size > 25 UNION SELECT DISTINCT lower(p_type), lower(p_type) FROM part WHERE p_size > 25) SELECT DISTINCT a.form, b.form AS other FROM g a JOIN g b ON a.g = b.g AND a.form <> b.form",
    "tags_by_synonym": f"WITH {ENTRIES}, {_SYN_SQL}, f AS (SELECT tag, trim(unnest(list_prepend(tag, aliases))) AS form FROM s) SELECT DISTINCT ord, tag FROM e JOIN f ON contains(lower(title), form)",
    "missing_synonyms": f"WITH {ENTRIES}, {_SYN_SQL} SELECT DISTINCT tag FROM (SELECT unnest(string_split(title, ' ')) AS tag FROM e) w WHERE tag NOT IN (SELECT tag FROM s WHERE len(aliases) > 0)",
    "merge_synonyms": "WITH b AS (SELECT DISTINCT p_type AS tag, p_brand FROM part) SELECT tag, string_agg(p_brand, '|' ORDER BY p_brand) AS aliases FROM b GROUP BY tag",
    "partition_detect": f"WITH {ENTRIES}, {_ALIAS_SQL} SELECT title, label FROM h QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1",
    "partition_detect_longest": f"WITH {ENTRIES}, {_ALIAS_SQL} SELECT title, label FROM h QUALIFY row_number() OVER (PARTITION BY title ORDER BY length(alias) DESC, ord) = 1",
    "distinct_in_order": "SELECT min(p_partkey) AS ord, p_name AS title FROM part GROUP BY p_name",
    "set_union": f"WITH {ENTRIES}, {_BRANDS} SELECT DISTINCT brand, k FROM b WHERE category IN ('SMALL', 'PROMO')",
    "set_intersect": f"WITH {ENTRIES}, {_BRANDS} SELECT brand, k FROM b WHERE category = 'SMALL' INTERSECT SELECT brand, k FROM b WHERE category = 'PROMO'",
    "set_except": f"WITH {ENTRIES}, {_BRANDS} SELECT brand, k FROM b WHERE category = 'SMALL' EXCEPT ALL SELECT brand, k FROM b WHERE category = 'PROMO'",
    "entry_index_search": f"""WITH {ENTRIES}, q AS (SELECT * FROM (VALUES (1::BIGINT, 4, 'ring'), (2, 3, 'red'), (3, 9, 'small'), (3, 9, 'ring'), (3, 9, 'smallring'), (4, 2, 'zz'), (6, 5, 'promo'), (7, 2, 'br'), (8, 2, 'ar'), (9, 5, 'brand'), (10, 2, '#1'), (11, 4, 'rand')) t(qid, n, tok)),
        f AS (SELECT ord, replace(lower(title), ' ', '') AS t, replace(lower(descr), ' ', '') AS x, lower(tags[1]) AS g1, lower(tags[2]) AS g2, areas[1] AS a FROM e),
        p AS (SELECT qid, n, ord, t, tok, instr(t, tok) - 1 AS pt, instr(x, tok) - 1 AS ax, instr(g1, tok) - 1 AS p1, instr(g2, tok) - 1 AS p2, instr(a, tok) - 1 AS pa FROM f, q),
        s AS (SELECT qid, n, ord, t, CASE WHEN pt >= 0 THEN greatest(CASE WHEN t = tok THEN 6.0 WHEN pt = 0 THEN 5.0 WHEN ends_with(t, tok) THEN 4.6 ELSE 4.2 END - CASE WHEN n <= 2 THEN 0.05 * least(pt, 20) ELSE 0 END, 0.5)
          ELSE greatest(CASE WHEN ax >= 0 THEN greatest(2.5 - CASE WHEN n <= 2 THEN 0.03 * least(ax, 40) ELSE 0 END, 0.3) ELSE 0 END, CASE WHEN p1 >= 0 THEN greatest(3.0 - CASE WHEN n <= 2 THEN 0.04 * least(p1, 40) ELSE 0 END, 0.4) ELSE 0 END, CASE WHEN p2 >= 0 THEN greatest(3.0 - CASE WHEN n <= 2 THEN 0.04 * least(p2, 40) ELSE 0 END, 0.4) ELSE 0 END, CASE WHEN pa >= 0 THEN greatest(2.0 - CASE WHEN n <= 2 THEN 0.03 * least(pa, 40) ELSE 0 END, 0.2) ELSE 0 END) END AS sc FROM p),
        g AS (SELECT qid, any_value(n) AS n, ord, any_value(t) AS t, sum(sc::DOUBLE) + greatest(0, 5 - 0.05 * length(any_value(t))) AS score FROM s GROUP BY qid, ord HAVING min(sc) > 0)
        SELECT qid, ord, round(score, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, t, ord) <= CASE WHEN n <= 2 THEN 5 ELSE 10 END""",
    "facet_search": f"""WITH {ENTRIES}, q AS (SELECT * FROM (VALUES (1::BIGINT, 4, 'ring', 'area1', NULL), (2, 4, 'ring', 'area2', 'promo'), (3, 5, 'small', 'area', NULL), (4, 4, 'bolt', NULL, 'brand#12')) t(qid, n, tok, qa, qt)),
        f AS (SELECT ord, replace(lower(title), ' ', '') AS t, replace(lower(descr), ' ', '') AS x, lower(tags[1]) AS g1, lower(tags[2]) AS g2, areas[1] AS a FROM e),
        p AS (SELECT qid, n, ord, t, tok, instr(t, tok) - 1 AS pt, instr(x, tok) - 1 AS ax, instr(g1, tok) - 1 AS p1, instr(g2, tok) - 1 AS p2, instr(a, tok) - 1 AS pa FROM f, q WHERE (qa IS NULL OR a = qa) AND (qt IS NULL OR g1 = qt OR g2 = qt)),
        s AS (SELECT qid, n, ord, t, CASE WHEN pt >= 0 THEN greatest(CASE WHEN t = tok THEN 6.0 WHEN pt = 0 THEN 5.0 WHEN ends_with(t, tok) THEN 4.6 ELSE 4.2 END - CASE WHEN n <= 2 THEN 0.05 * least(pt, 20) ELSE 0 END, 0.5)
          ELSE greatest(CASE WHEN ax >= 0 THEN greatest(2.5 - CASE WHEN n <= 2 THEN 0.03 * least(ax, 40) ELSE 0 END, 0.3) ELSE 0 END, CASE WHEN p1 >= 0 THEN greatest(3.0 - CASE WHEN n <= 2 THEN 0.04 * least(p1, 40) ELSE 0 END, 0.4) ELSE 0 END, CASE WHEN p2 >= 0 THEN greatest(3.0 - CASE WHEN n <= 2 THEN 0.04 * least(p2, 40) ELSE 0 END, 0.4) ELSE 0 END, CASE WHEN pa >= 0 THEN greatest(2.0 - CASE WHEN n <= 2 THEN 0.03 * least(pa, 40) ELSE 0 END, 0.2) ELSE 0 END) END AS sc FROM p),
        g AS (SELECT qid, any_value(n) AS n, ord, any_value(t) AS t, sum(sc::DOUBLE) + greatest(0, 5 - 0.05 * length(any_value(t))) AS score FROM s GROUP BY qid, ord HAVING min(sc) > 0)
        SELECT qid, ord, round(score, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, t, ord) <= CASE WHEN n <= 2 THEN 5 ELSE 10 END""",
    "partition_entries": f"WITH {ENTRIES} SELECT ord FROM e WHERE updated % 4 IN (0, 2) AND areas[1] IN ('area1', 'area3')",
    "tourism_synonyms": f"""WITH {ENTRIES}, q AS (SELECT * FROM (VALUES (1::BIGINT, 'band', NULL), (1, 'ring', NULL), (1, 'loop', NULL), (2, 'gadget', 'area2'), (2, 'widget', 'area2'), (2, 'small', 'area2')) t(qid, tok, qc)),
        f AS (SELECT e.*, replace(lower(title), ' ', '') AS t, replace(lower(descr), ' ', '') AS x FROM e),
        s AS (SELECT qid, ord, updated, t, greatest(CASE WHEN t = tok THEN 20.0 WHEN instr(t, tok) = 0 THEN 0 WHEN instr(t, tok) <= 4 THEN 12 ELSE 8 END, CASE WHEN contains(x, tok) THEN 4 ELSE 0 END, CASE WHEN contains(lower(tags[1]), tok) OR contains(lower(tags[2]), tok) THEN 3 ELSE 0 END) AS s0, coalesce(city = qc, false) AS same FROM f, q),
        g AS (SELECT qid, ord, any_value(updated) AS updated, any_value(t) AS t, sum(s0) AS s0, any_value(same) AS same FROM s GROUP BY qid, ord), r AS (SELECT *, CAST(s0 + CASE WHEN same THEN 4 ELSE 0 END AS DOUBLE) AS score FROM g WHERE s0 > 0)
        SELECT qid, ord, score, score >= 8 AS direct FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, updated DESC, length(t), t, ord) <= 5""",
    "title_lookup": "WITH f AS (SELECT lower(p_name) AS k, min(p_partkey) AS ord, arg_min(p_type, p_partkey) AS category FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, ord, category FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f ON f.k = lower(p_name)",
    "vector_lookup": "SELECT doc_id, lang, label, CAST(len(embedding) AS BIGINT) AS size FROM documents JOIN embeddings ON doc_id = vec_id",
    "import_entries": "SELECT p_partkey AS ord, p_name AS title, p_type AS category FROM part UNION ALL SELECT -s_suppkey - 1, s_name, 'other' FROM supplier",
    "queue_take": "WITH q AS (SELECT title, row_number() OVER (ORDER BY title) AS place FROM (SELECT DISTINCT p_name AS title FROM part)), k AS (SELECT * FROM q WHERE place > 5 ORDER BY place LIMIT 100) SELECT title, place FROM k WHERE lower(title) NOT IN (SELECT lower(p_name) FROM part WHERE p_size % 5 = 0 AND p_retailprice < 950)",
    "manifest_prune": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "kwic": r"""WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents), h AS (SELECT doc_id, t, regexp_extract_all(t, '(?i)clown|idiot') AS h, regexp_split_to_array(t, '(?i)clown|idiot') AS b FROM d),
        x AS (SELECT doc_id, t, unnest(h) AS h, unnest(b[:len(h)]) AS b, generate_subscripts(h, 1) AS p FROM h WHERE len(h) > 0),
        y AS (SELECT *, coalesce(sum(length(h) + length(b)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(b) AS s FROM x),
        z AS (SELECT doc_id, p, regexp_replace(substr(t, CAST(greatest(s - 80, 0) + 1 AS BIGINT), CAST(s + length(h) + 80 - greatest(s - 80, 0) AS BIGINT)), '^\s+|\s+$', '', 'g') AS snippet FROM y)
        SELECT min((doc_id, p))[1] AS doc_id, md5(snippet) AS md5 FROM z WHERE snippet <> '' GROUP BY snippet ORDER BY min((doc_id, p)) LIMIT 50""",
    "tourism_search": f"""WITH {ENTRIES}, q AS (SELECT * FROM (VALUES (1::BIGINT, 'ring', NULL), (2, 'small', 'area2'), (3, 'promo', NULL)) t(qid, tok, qc)),
        f AS (SELECT e.*, replace(lower(title), ' ', '') AS t, replace(lower(descr), ' ', '') AS x FROM e),
        s AS (SELECT qid, ord, updated, t, greatest(CASE WHEN t = tok THEN 20.0 WHEN instr(t, tok) = 0 THEN 0 WHEN instr(t, tok) <= 4 THEN 12 ELSE 8 END, CASE WHEN contains(x, tok) THEN 4 ELSE 0 END, CASE WHEN contains(lower(tags[1]), tok) OR contains(lower(tags[2]), tok) THEN 3 ELSE 0 END) AS s0, coalesce(city = qc, false) AS same FROM f, q),
        r AS (SELECT qid, ord, updated, t, CAST(s0 + CASE WHEN same THEN 4 ELSE 0 END AS DOUBLE) AS score FROM s WHERE s0 > 0)
        SELECT qid, ord, score, score >= 8 AS direct FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, updated DESC, length(t), t, ord) <= 3""",
    "prioritized_search": f"WITH {ENTRIES}, {_PRIO} SELECT qid, ord, CAST(stage AS BIGINT) AS stage FROM w WHERE qid <= 4",
    "cascade_search": f"""WITH {ENTRIES}, q AS (SELECT * FROM (VALUES (1::BIGINT, 'Small Ring', 'area1'), (2, 'ring', 'area2'), (3, 'PROMO sale', NULL), (4, 'red', 'nowhere')) t(qid, query, area)),
        h AS (SELECT qid, ord, CASE WHEN lower(title) = lower(query) AND (area IS NULL OR list_contains(areas, area)) THEN 0 WHEN contains(lower(title || chr(10) || descr || chr(10) || tags[1] || chr(10) || tags[2]), lower(query)) AND (area IS NULL OR list_contains(areas, area)) THEN 1
          WHEN contains(title, query) OR contains(descr, query) THEN 2 WHEN (contains(lower(query), lower(tags[1])) OR contains(lower(query), lower(tags[2]))) AND (area IS NULL OR list_contains(areas, area)) THEN 3 END AS stage FROM e, q)
        SELECT qid, ord, CAST(stage AS BIGINT) AS stage FROM h WHERE stage IS NOT NULL QUALIFY stage = min(stage) OVER (PARTITION BY qid)""",
    "slot_search": f"""WITH {ENTRIES}, s AS (SELECT ord, CASE WHEN updated % 6 > 0 THEN city END AS area, CASE WHEN updated % 4 > 0 THEN lower(category) || ' things' END AS topic, CASE WHEN price < 950 THEN 'low' WHEN price < 1200 THEN '' ELSE 'high' END AS pr, updated % 7 = 0 AS shut,
          CASE WHEN updated > 10 THEN '20' || updated || '-01-01' ELSE '2000-01-01' END AS u, CAST(list_contains(tags, 'PROMO') AS BIGINT) + CAST(list_contains(tags, 'SMALL') AS BIGINT) + CAST(list_contains(tags, 'Brand#2') AS BIGINT) AS shared FROM e)
        SELECT ord, shared FROM s WHERE shared > 0 AND contains(area, 'area1') AND (topic IS NULL OR contains(topic, 'promo')) AND pr IN ('', 'low') AND NOT shut ORDER BY shared DESC, u DESC, ord LIMIT 5""",
    "progressive_filter": f"WITH {ENTRIES}, m AS (SELECT *, contains(title, 'ring') AND updated > 45 AS m FROM e) SELECT city, ord FROM m QUALIFY m OR NOT bool_or(m) OVER (PARTITION BY city)",
    "fragment_overlap": r"""WITH f AS (SELECT text, min(item_id) AS ord, regexp_extract_all(lower(text), '[0-9a-z一-龥ぁ-んァ-ンー]+') AS w FROM benchmark GROUP BY text), q AS (SELECT * FROM (VALUES (1::BIGINT, ['the', 'the', 'that', 'on']), (2, ['zzz']), (3, ['and'])) t(qid, toks)),
        s AS (SELECT qid, text, ord, len(list_filter(toks, lambda t: list_contains(w, t))) AS score FROM f, q), a AS (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM s)
        SELECT qid, md5(text) AS md5, CAST(score AS BIGINT) AS score FROM a WHERE score > 0 OR m = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN m > 0 THEN -length(text) END, ord) <= 3""",
    "nearby_places": f"""WITH {ENTRIES}, c AS (SELECT s_suppkey AS cid, 32.5 + s_suppkey / 10 AS clat, 128.5 + s_suppkey / 7 AS clng FROM supplier WHERE 32.5 + s_suppkey / 10 <= 90),
        d AS (SELECT cid, ord, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2)))) * 1000 AS m FROM e, c), r AS (SELECT cid, ord, CAST(round_even(m, 0) AS BIGINT) AS distance_m FROM d WHERE m <= 9000)
        SELECT cid, ord, distance_m FROM r QUALIFY row_number() OVER (PARTITION BY cid ORDER BY distance_m, ord) <= 10""",
    "nearby_around_the_globe": f"""WITH {ENTRIES}, p AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN lat + 56.9 ELSE lat END AS lat, lng + CASE WHEN lng > 129 THEN 50 ELSE -308 END AS lng FROM e WHERE category IN ('PROMO', 'SMALL')),
        c AS (SELECT s_suppkey AS cid, CASE WHEN s_suppkey % 2 = 0 THEN 89.9 ELSE 33.0 END AS clat, CASE WHEN s_suppkey % 3 = 0 THEN 179.99 ELSE -179.99 END AS clng FROM supplier),
        d AS (SELECT cid, ord, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2)))) * 1000 AS m FROM p, c WHERE lat BETWEEN -90 AND 90), r AS (SELECT cid, ord, CAST(round_even(m, 0) AS BIGINT) AS distance_m FROM d WHERE m <= 60000)
        SELECT cid, ord, distance_m FROM r QUALIFY row_number() OVER (PARTITION BY cid ORDER BY distance_m, ord) <= 10""",
    "responder_states": f"""WITH {ENTRIES}, {_PRIO}, x AS (SELECT qid, ord, title, row_number() OVER (PARTITION BY qid ORDER BY ord) AS r, count(*) OVER (PARTITION BY qid) AS n FROM w),
        y AS (SELECT qid, any_value(n) AS n, string_agg(title, ' / ' ORDER BY ord) FILTER (WHERE r <= 3) AS preview FROM x GROUP BY qid),
        v AS (SELECT w.qid, w.ord, unnest(['area', 'tag', 'tag']) AS kind, unnest([e.areas[1], e.tags[1], e.tags[2]]) AS value, unnest([0, 0, 1]) AS p FROM w JOIN e ON e.ord = w.ord), c AS (SELECT qid, kind, value, count(*) AS k, min(ord * 2 + p) AS f FROM v GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kind, k DESC, f) AS r FROM c), l AS (SELECT qid, string_agg(kind || ':' || value, '|' ORDER BY r) AS facets FROM t WHERE r <= 5 GROUP BY qid)
        SELECT z.qid, CASE WHEN n IS NULL THEN 'no_hit' WHEN n = 1 THEN 'detail' ELSE 'choices' END AS status, coalesce(preview, '') AS preview, CASE WHEN n > 1 THEN facets ELSE '' END AS facets FROM (VALUES (1::BIGINT, 1::BIGINT), (2, 4), (3, 5)) z(qid, k) LEFT JOIN y ON y.qid = z.k LEFT JOIN l ON l.qid = z.k""",
}
