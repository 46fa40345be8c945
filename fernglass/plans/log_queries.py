"""Queries over the question log and the catalogue's facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import analytics as A
from fernglass.plans.views import ENTRIES, LOG, entries, log
from fernglass.session import numbered, table

_us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def unhit_frequency(spark, d):
    return A.unhit_frequency(log(spark, d), question="question", ts="ts", hit="hit", order="ord", days=7)


def log_filter(spark, d):
    return A.log_filter(log(spark, d), "Q4", ["question", "source"], ts="ts", limit=100_000).select("ord", "question", "source")


def log_page_filter(spark, d):
    return A.log_page_filter(log(spark, d), question="question", ts="ts", hit="hit", needle="q1", source="view", only="hit", start="2024-01-05", end="2024-01-12").select("ord", "question")


def log_group_by_question(spark, d):
    return A.group_by_question(log(spark, d), question=T.title_key(F.col("question")), ts="ts", hit="hit").select("question", "n", "hits", "misses", _us("first_ts").alias("first_us"), _us("last_ts").alias("last_us"))


def report_totals(spark, d):
    groups = A.unhit_frequency(log(spark, d), question="question", ts="ts", hit="hit", order="ord", days=30)
    return A.report_filter(groups, needle="q", least=2).agg(F.count("*").alias("groups"), F.sum("n").alias("total"))


def recent_logs(spark, d):
    return A.page(log(spark, d), F.desc_nulls_last("ts"), F.desc("ord"), number=2, size=50).select("ord", "question")


def hit_miss_daily(spark, d):
    return log(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def top_tags(spark, d):
    return A.top_tags(entries(spark, d), tags="tags", order="ord", k=8)


def facets(spark, d):
    return A.facets(entries(spark, d).where(F.col("title").contains("ring")), areas="areas", tags="tags", order="ord", limit=9)


def dashboard_counts(spark, d):
    return A.counts(entries=entries(spark, d), log=log(spark, d), documents=table(spark, d, "documents"))


def discriminative_tags(spark, d):
    return A.discriminative_tags(entries(spark, d), group="title", tags="tags")


def discriminative_tags_all(spark, d):
    return A.discriminative_tags(entries(spark, d), group="category", tags="tags", fall_back=True)


def keyword_argmax(spark, d):
    return A.keyword_argmax(table(spark, d, "documents"), ["Ｔhe", "AND", "a"], text="text", key="doc_id")


def status_roll_up(spark, d):
    return A.status_roll_up(log(spark, d).select(F.when(F.col("source") == "error", "unknown").otherwise("ready").alias("s")), state="s")


def interval_overlap_week(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("s"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("interval 10 days")).alias("e"))
    return A.week_overlap(o, F.lit("1997-06-18").cast("date"), start="s", end="e").select("o_orderkey")


def estimated_bytes(spark, d):
    return A.estimated_bytes(table(spark, d, "documents").select(F.octet_length("text").alias("n")), size="n")


def retention_newest_n(spark, d):
    return A.retention(table(spark, d, "orders"), group="o_custkey", ts="o_orderdate", tie="o_orderkey", newest=3).select("o_custkey", "o_orderkey")


def ranked_tags(spark, d):
    tags = A.top_tags(entries(spark, d), tags="tags", order="ord", k=100).withColumn("ord", F.col("n"))
    return A.ranked_tags(tags, {"PROMO": ["PROMO", "SMALL"], "things": ["SMALL", "Brand#12", "PROMO"], "rain": ["LARGE"]}, "a PROMO of small things", tag="tag", order="ord").select("tag", F.col("weight").cast("long").alias("weight"))


def locale_sort(spark, d):
    """Titles, some with a capital or with kana before them, by the collation of Japanese."""
    kana = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("い"), "title")).when(F.col("ord") % 5 == 1, F.concat(F.lit("ア"), "title")).when(F.col("ord") % 5 == 2, F.initcap("title")).otherwise(F.col("title"))
    t = entries(spark, d).select(kana.alias("title")).distinct()
    return numbered(t, F.collate("title", "ja"), F.col("title"), name="place").select("title", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (unhit_frequency, log_filter, log_page_filter, log_group_by_question, report_totals, recent_logs, hit_miss_daily, top_tags, facets, dashboard_counts, discriminative_tags, discriminative_tags_all, keyword_argmax, status_roll_up, interval_overlap_week, estimated_bytes, retention_newest_n, ranked_tags, locale_sort)}

_UNHIT = "SELECT question, count(*) AS n, max(ord) AS last_order FROM l, (SELECT max(ts) AS now FROM l) WHERE floor((epoch_us(now) - epoch_us(ts)) / 86400000000) <= {days} AND NOT hit GROUP BY question"

ORACLE_SQL = {
    "unhit_frequency": f"WITH {LOG} {_UNHIT.format(days=7)}",
    "log_filter": f"WITH {LOG} SELECT ord, question, source FROM l WHERE contains(lower(question || chr(10) || source), 'q4') ORDER BY ts DESC, question, source LIMIT 2000",
    "log_page_filter": f"WITH {LOG} SELECT ord, question FROM l WHERE contains(question, 'q1') AND source = 'view' AND hit AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'",
    "log_group_by_question": f"WITH {LOG} SELECT lower(trim(question)) AS question, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM l GROUP BY 1",
    "report_totals": f"WITH {LOG}, g AS ({_UNHIT.format(days=30)}) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total FROM g WHERE n >= 2",
    "recent_logs": f"WITH {LOG} SELECT ord, question FROM l ORDER BY ts DESC, ord DESC LIMIT 50 OFFSET 50",
    "hit_miss_daily": f"WITH {LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM l GROUP BY 1",
    "top_tags": f"WITH {ENTRIES}, t AS (SELECT unnest(tags) AS tag, ord * 10 + unnest(range(len(tags))) AS ord FROM e) SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, min(ord) LIMIT 8",
    "facets": f"""WITH {ENTRIES}, m AS (SELECT * FROM e WHERE contains(title, 'ring')), v AS (SELECT 'area' AS kind, 0 AS r, unnest(areas) AS value, ord * 10 + unnest(range(len(areas))) AS ord FROM m UNION ALL SELECT 'tag', 1, unnest(tags), ord * 10 + unnest(range(len(tags))) FROM m)
        SELECT kind, value, count(*) AS n FROM v GROUP BY kind, r, value ORDER BY r, n DESC, min(ord) LIMIT 9""",
    "dashboard_counts": "SELECT 'entries' AS name, count(*) AS n FROM part UNION ALL SELECT 'log', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents",
    "discriminative_tags": f"""WITH {ENTRIES}, n AS (SELECT title, count(*) AS n FROM e GROUP BY title), t AS (SELECT title, tag, count(DISTINCT ord) AS k FROM (SELECT title, ord, unnest(tags) AS tag FROM e) GROUP BY 1, 2),
        r AS (SELECT t.title, tag, row_number() OVER (PARTITION BY t.title ORDER BY tag) AS r FROM t JOIN n ON n.title = t.title WHERE k < n.n OR n.n = 1) SELECT title, tag FROM r WHERE r <= 12""",
    "discriminative_tags_all": f"""WITH {ENTRIES}, n AS (SELECT category, count(*) AS n FROM e GROUP BY 1), t AS (SELECT category, tag, count(DISTINCT ord) AS k FROM (SELECT category, ord, unnest(tags) AS tag FROM e) GROUP BY 1, 2),
        a AS (SELECT t.*, n.n, max(CAST(k < n.n AS INT)) OVER (PARTITION BY t.category) AS anyd FROM t JOIN n ON n.category = t.category), r AS (SELECT category, tag, row_number() OVER (PARTITION BY category ORDER BY tag) AS r FROM a WHERE k < n OR anyd = 0)
        SELECT category, tag FROM r WHERE r <= 12""",
    "keyword_argmax": "SELECT doc_id, CAST(len(string_split(lower(text), 'the')) - 1 + len(string_split(lower(text), 'and')) - 1 AS BIGINT) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 1",
    "status_roll_up": f"WITH {LOG} SELECT CASE WHEN bool_or(source = 'error') THEN 'unknown' ELSE 'ready' END AS overall FROM l",
    "interval_overlap_week": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate + INTERVAL 10 DAY AS DATE) ELSE CAST(o_orderdate AS DATE) END AS e FROM orders)
        SELECT o_orderkey FROM o WHERE e >= DATE '1997-06-16' AND s <= DATE '1997-06-22'""",
    "estimated_bytes": "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(floor(sum(strlen(text)) * 1.08::DOUBLE) AS BIGINT) + 1000000 AS needed FROM documents",
    "retention_newest_n": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3",
    "ranked_tags": f"WITH {ENTRIES}, t AS (SELECT unnest(tags) AS tag FROM e) SELECT tag, CAST(CASE tag WHEN 'PROMO' THEN 198 WHEN 'SMALL' THEN 199 WHEN 'Brand#12' THEN 99 ELSE 0 END AS BIGINT) AS weight FROM t GROUP BY tag",
    "locale_sort": """WITH t AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'い' || p_name WHEN 1 THEN 'ア' || p_name WHEN 2 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS title FROM part)
        SELECT title, row_number() OVER (ORDER BY CASE WHEN starts_with(title, 'ア') THEN 1 WHEN starts_with(title, 'い') THEN 2 ELSE 0 END, lower(title), CASE WHEN title = lower(title) THEN 0 ELSE 1 END) AS place FROM t""",
}
