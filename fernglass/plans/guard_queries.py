"""Queries over event guards, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.operators import search
from fernglass.plans import dialogue, routing
from fernglass.plans.views import entries
from fernglass.session import table
from fernglass.streaming import guards as G
from fernglass.streaming import outbound

_us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
_kind = lambda: F.col("event_type")


def _events(spark, d):
    return table(spark, d, "events")


def ttl_dedupe(spark, d):
    return G.ttl_dedupe(_events(spark, d), ["user_id", "event_type"], ts="ts", tie="event_id", ttl_seconds=6 * 3600).select("event_id")


def notice_once(spark, d):
    return G.ttl_dedupe(_events(spark, d), ["user_id"], ts="ts", tie="event_id", ttl_seconds=86_400, inclusive=False).select("event_id")


def consecutive_duplicate(spark, d):
    return G.utterance_gate(_events(spark, d), user="user_id", text="event_type", ts="ts", tie="event_id", ttl_seconds=86_400).select("event_id", "reason")


def accepted_events(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "ts", F.floor(F.col("value")).cast("string").alias("message"), "event_type")
    e = e.withColumn("sent", F.col("ts") - F.make_dt_interval(secs=F.col("event_id") % 300))
    return G.accepted_events(e, message="message", user="user_id", text="event_type", ts="ts", tie="event_id", sent=F.col("sent"), ttl_seconds=6 * 3600).select("event_id")


def _responses(spark, d):
    e = _events(spark, d)
    return e.select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("request"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("payload"), (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("int") - 50)).alias("until"))


def response_suppression(spark, d):
    return G.suppressed(_responses(spark, d), scope="user_id", request="request", payload="payload", ts="ts", tie="event_id", ttl_seconds=86_400).select("event_id", "suppressed")


def outbound_ways(spark, d):
    return G.outbound(_responses(spark, d), scope="user_id", request="request", payload="payload", token_until="until", ts="ts", tie="event_id").select("event_id", "way")


def outbound_guard(spark, d):
    """All events as what is sent to their users, with failures and pauses among them, each with what becomes of it."""
    e, kind = _responses(spark, d), F.col("event_id") % 10
    control, fails = kind.isin(3, 4), kind == 5
    rows = e.select(
        "event_id", "user_id", "ts", F.when(control, "control").when(fails, "failed").otherwise("send").alias("kind"), F.concat(F.lit("e"), F.floor(F.col("event_id") / 20).cast("string")).alias("event"), "request", "payload",
        F.col("until").alias("token_until"), F.when(F.col("event_id") % 20 == 3, "admin").otherwise("user").alias("who"), F.when(kind == 3, "pause").otherwise("resume").alias("action"), (F.col("ts") + F.expr("interval 1 hour")).alias("until"),
    )
    return outbound.outcomes(rows, target="user_id", ts="ts", tie="event_id").select("event_id", "outcome")


def answered_before(spark, d):
    q = _events(spark, d).select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("key"))
    return G.answered_before(q, user="user_id", key="key", ts="ts", tie="event_id", depth=10).select("event_id", "repeated")


def remembered_value(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("v"))
    return G.remembered(e, user="user_id", value="v", ts="ts", tie="event_id", ttl="8 hours").select("event_id", "known")


def user_flags(spark, d):
    changes = _events(spark, d).where("event_type in ('signup', 'error')").select(F.col("user_id").alias("c_custkey"), (F.col("event_type") == "error").alias("flag"), F.struct("ts", "event_id").alias("at"))
    return G.flags(changes, table(spark, d, "customer").select("c_custkey"), user="c_custkey", flag="flag", ts="at")


def rate_limit_minute(spark, d):
    r = G.rate_limit(_events(spark, d), user="event_type", ts="ts", window="1 minute", limit=1)
    return r.select("event_type", _us("start").alias("start_us"), "n", "refused")


def late_drop(spark, d):
    e = _events(spark, d).withColumn("now", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 300))
    return G.on_time(e, event_ts=F.col("ts"), now=F.col("now")).select("event_id")


def session_windows(spark, d):
    s = G.sessions(_events(spark, d), user="user_id", ts="ts", gap="6 hours")
    return s.select("user_id", _us("start").alias("start_us"), _us("end").alias("end_us"), "n")


def rate_limit_day(spark, d):
    return G.rate_limit(_events(spark, d), user="event_type", ts="ts", window="1 day", limit=7).select("event_type", _us("start").alias("start_us"), "n", "refused")


def latest_control_asof(spark, d):
    e = _events(spark, d)
    c = e.where("event_type in ('signup', 'error')").select("user_id", "ts", "event_id", F.when(_kind() == "signup", "pause").otherwise("resume").alias("action"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 36 hours")).alias("until"))
    return G.pause_state(c, e.where("event_type = 'click'"), user="user_id", ts="ts", tie="event_id").select("event_id", "paused")


def newest_generation(spark, d):
    return G.newest_generation(_events(spark, d).withColumn("g", F.floor(F.col("value")).cast("long")), key="user_id", generation="g").select("event_id")


def narrowed_dialogues(spark, d):
    """All conversations, whose turns search the entries and narrow what was found."""
    said = ["small ring", "@area:area1", "@tag:PROMO", "ring", "@tag: SMALL", "@area:Area2", "bolt red", None]
    c = table(spark, d, "conversations")
    turns = c.select("conv_id", "turn", F.coalesce(F.get(F.array(*[F.lit(x) for x in said]), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(said))).cast("int")), "text").alias("text"))
    e = entries(spark, d).withColumns({"title_forms": F.expr("cast(array() as array<string>)"), "aux": F.array("desc")})
    got = dialogue.replies(turns, e, lambda q: search.search_index(e, q, limit=1000, facets=True), conv="conv_id", turn="turn", text="text")
    return got.select("conv_id", "turn", "kind", "n", "first", F.md5("preview").alias("preview"), "options")


def ask_pipeline(spark, d):
    """All users' questions, some of them about a fixed topic or a part, answered from intents, parts and passages."""
    before = F.when(F.col("conv_id") % 3 == 0, "フェリー ").when(F.col("conv_id") % 3 == 1, "the small ring ").otherwise("")
    q = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(before, "text").alias("question"))
    f = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), "text")
    got = routing.ask(q, entries(spark, d).select("ord", "title"), f, now=F.lit("2024-02-01").cast("timestamp_ntz"))
    return got.select("qid", "route", "hit", F.md5("answer").alias("answer_md5"))


QUERIES = {f.__name__: f for f in (ttl_dedupe, notice_once, consecutive_duplicate, late_drop, session_windows, rate_limit_day, rate_limit_minute, latest_control_asof, newest_generation, accepted_events, response_suppression, outbound_ways, outbound_guard, answered_before, remembered_value, user_flags, ask_pipeline, narrowed_dialogues)}

_GAP = """WITH RECURSIVE e AS (SELECT {keys} AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS r FROM events),
  g AS (SELECT k, event_id, t, r, t AS last, true AS keep FROM e WHERE r = 1
  UNION ALL SELECT e.k, e.event_id, e.t, e.r, CASE WHEN e.t - g.last {op} {ttl} THEN e.t ELSE g.last END, e.t - g.last {op} {ttl} FROM g JOIN e ON e.k = g.k AND e.r = g.r + 1) SELECT event_id FROM g WHERE keep"""

ORACLE_SQL = {
    "ttl_dedupe": _GAP.format(keys="user_id || event_type", op=">", ttl=6 * 3600 * 1_000_000),
    "notice_once": _GAP.format(keys="user_id", op=">=", ttl=86_400 * 1_000_000),
    "late_drop": "SELECT event_id FROM events WHERE event_id % 300 <= 150",
    "session_windows": """WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e) SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, sid""",
    "rate_limit_day": "SELECT event_type, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, count(*) AS n, count(*) - 7 AS refused FROM events GROUP BY event_type, date_trunc('day', ts) HAVING count(*) > 7",
    "latest_control_asof": """WITH c AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'pause' ELSE 'resume' END AS action, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 36 HOUR END AS until FROM events WHERE event_type IN ('signup', 'error'))
        SELECT p.event_id, coalesce(c.action = 'pause' AND (c.until IS NULL OR c.until > p.ts), false) AS paused FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "newest_generation": "SELECT event_id FROM events QUALIFY floor(value) = max(floor(value)) OVER (PARTITION BY user_id)",
    "consecutive_duplicate": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS x, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
        g AS (SELECT user_id, event_id, r, x AS last, t AS held, CAST(NULL AS VARCHAR) AS reason FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.x = last AND e.t - held < 86400000000 THEN last ELSE e.x END, CASE WHEN e.x = last AND e.t - held < 86400000000 THEN held ELSE e.t END, CASE WHEN e.x = last AND e.t - held < 86400000000 THEN 'duplicate' END FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1) SELECT event_id, reason FROM g""",
    "accepted_events": """WITH RECURSIVE a AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, CAST(floor(value) AS BIGINT) AS m FROM events WHERE event_id % 300 <= 150), e AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY t, event_id) AS r FROM a),
        g AS (SELECT m, event_id, r, t AS last, true AS keep FROM e WHERE r = 1 UNION ALL SELECT e.m, e.event_id, e.r, CASE WHEN e.t - last > 21600000000 THEN e.t ELSE last END, e.t - last > 21600000000 FROM g JOIN e ON e.m = g.m AND e.r = g.r + 1),
        b AS (SELECT a.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, a.event_id) AS r FROM a JOIN g ON g.event_id = a.event_id WHERE keep),
        h AS (SELECT user_id, event_type, event_id, r, t AS last, true AS keep FROM b WHERE r = 1 UNION ALL SELECT b.user_id, b.event_type, b.event_id, b.r, CASE WHEN b.t - last > 21600000000 THEN b.t ELSE last END, b.t - last > 21600000000 FROM h JOIN b ON b.user_id = h.user_id AND b.event_type = h.event_type AND b.r = h.r + 1) SELECT event_id FROM h WHERE keep""",
    "remembered_value": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 28800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
        SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, sid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM s""",
    "user_flags": "WITH l AS (SELECT user_id, arg_max(event_type = 'error', (ts, event_id)) AS flag FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id) SELECT c_custkey, coalesce(flag, false) AS flag FROM customer LEFT JOIN l ON l.user_id = c_custkey",
    "rate_limit_minute": "SELECT event_type, epoch_us(date_trunc('minute', ts)::TIMESTAMP) AS start_us, count(*) AS n, count(*) - 1 AS refused FROM events GROUP BY event_type, date_trunc('minute', ts) HAVING count(*) > 1",
    "ask_pipeline": r"""WITH q AS (SELECT conv_id * 1000 + turn AS qid, CASE conv_id % 3 WHEN 0 THEN 'フェリー ' WHEN 1 THEN 'the small ring ' ELSE '' END || text AS q FROM conversations WHERE role = 'user'),
        i AS (SELECT qid, q, CASE WHEN contains(lower(q), 'weather') THEN 'weather' WHEN regexp_matches(lower(q), 'フェリー|status|ana|jal|orc') THEN 'transport' WHEN regexp_matches(lower(q), 'viewpoints?\s*map') THEN 'viewpoint_map' END AS i FROM q),
        p AS (SELECT p_name, min(p_partkey) AS o FROM part GROUP BY 1), n AS (SELECT qid, arg_min(p_name, o) AS title FROM i JOIN p ON contains(lower(q), lower(p_name)) GROUP BY qid),
        w AS (SELECT qid, w, count(*) AS k FROM (SELECT qid, unnest(regexp_extract_all(lower(q), '[0-9a-z一-龥ぁ-んァ-ンー]+')) AS w FROM i) GROUP BY ALL), b AS (SELECT text, min(item_id) AS o, list_distinct(regexp_extract_all(lower(text), '[0-9a-z一-龥ぁ-んァ-ンー]+')) AS ws FROM benchmark GROUP BY text), bw AS (SELECT text, o, unnest(ws) AS w FROM b),
        s AS (SELECT qid, text, o, sum(k) AS score FROM w JOIN bw USING (w) GROUP BY ALL), f AS (SELECT qid, text FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(text) DESC, o) = 1),
        r AS (SELECT i.qid, CASE WHEN i IS NOT NULL THEN 'special' WHEN title IS NOT NULL THEN 'entries' WHEN f.text IS NOT NULL THEN 'documents' ELSE 'no_answer' END AS route, coalesce(i, title, f.text, '') AS answer FROM i LEFT JOIN n ON n.qid = i.qid LEFT JOIN f ON f.qid = i.qid)
        SELECT qid, route, route <> 'no_answer' AS hit, md5(answer) AS answer_md5 FROM r""",
}
