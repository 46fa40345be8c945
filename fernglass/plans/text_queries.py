"""Queries over text functions and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import geo, records
from fernglass.functions import text as T
from fernglass.operators import answers
from fernglass.plans import routing
from fernglass.plans.views import ENTRIES, entries
from fernglass.session import table


def norm_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.title_key(F.concat(F.lit("  "), "text")).alias("norm"))


def split_list(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.split_list(F.col("text"))).alias("item"))


def tokens_regex(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.word_tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("n"))


def char_bigrams(spark, d):
    return table(spark, d, "part").select(F.explode(T.grams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


def chunk_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(T.windows(F.col("text"))).alias("w")).select("doc_id", "w.*")
    return w.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end", "line_start", "line_end")], F.md5("text").alias("md5"))


def fragment_pack(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.fragments(F.col("text"))).cast("long").alias("n"), F.length(F.concat_ws("", T.fragments(F.col("text")))).cast("long").alias("chars"))


def lang_id(spark, d):
    """Documents, and the same with a Chinese word, with kana, or without their marks."""
    marked = F.array("text", F.concat("text", F.lit(" 交通")), F.concat("text", F.lit(" かな 交通")), F.regexp_replace("text", r"[^A-Za-z0-9 ]", " "), F.lit("  "))
    return table(spark, d, "documents").select(F.posexplode(marked).alias("form", "t")).groupBy(F.col("form").cast("long").alias("form"), T.language(F.col("t")).alias("lang")).agg(F.count("*").alias("n"))


def ttl_parse(spark, d):
    """Pauses that are made of the line items' numbers, in six ways to write them."""
    n = F.col("l_linenumber").cast("string")
    ways = F.array(F.concat(F.lit("stop "), n, F.lit(" minutes")), F.concat(F.lit("pause "), n, F.lit("h")), F.concat(F.lit("停止 "), n, F.lit("分")), F.concat(F.translate(n, "1234567", "１２３４５６７"), F.lit("日")), F.lit("stop"), F.concat(n, F.lit(" hour 5 minutes")))
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(ways, ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1).cast("int")).alias("text"))
    return i.select("l_orderkey", "l_linenumber", T.ttl_seconds(F.col("text")).alias("seconds"))


def label_extract(spark, d):
    text = F.concat("text", F.lit(" [["), (F.col("item_id") % 7).cast("string"), F.lit("]] x [[2]]"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(T.labels(text), lambda x: x.cast("string")), ",").alias("labels"))


def kana_fold(spark, d):
    """Part names with words in kana of all widths behind them."""
    words = F.array(*[F.lit(w) for w in ("カタカナ", "ｶﾞｲﾄﾞ", "ヴァイオリン", "Ｔｏｋｙｏ　〜", "ヵヶ")])
    return table(spark, d, "part").select("p_partkey", T.search_form(F.concat("p_name", F.lit("　"), F.element_at(words, (F.col("p_partkey") % 5 + 1).cast("int")))).alias("folded"))


def json_value(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.try_variant_get(records.loose_json(F.concat(F.lit("```json\n"), "props", F.lit("```"))), "$.k", "long").alias("k"))


def text_hashes(spark, d):
    return table(spark, d, "events").select("event_id", T.text_key(F.col("user_id"), F.col("event_type")).alias("text_key"), T.user_hash(F.col("user_id")).alias("user_hash"))


def source_parts(spark, d):
    s = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt/L1-9"))
    return table(spark, d, "documents").select("doc_id", T.source_parts(s).alias("p")).select("doc_id", "p.folder", "p.file", "p.lines")


def coord_parse(spark, d):
    s = table(spark, d, "supplier").withColumn("lat", (32 + (F.col("s_suppkey") % 100) / 50)).withColumn("lng", (128 + (F.col("s_suppkey") % 97) / 50))
    url = F.concat(F.lit("https://maps.example.com/maps?q="), F.format_string("%.4f", "lat"), F.lit(","), F.format_string("%.4f", "lng"))
    return s.select("s_suppkey", geo.coordinates(url).alias("c")).select("s_suppkey", "c.lat", "c.lng")


def url_host(spark, d):
    return table(spark, d, "pages").groupBy(F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


def truthy_values(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("yes", "off", "TRUE", "", "maybe", "t", "null", "2")]), (F.col("event_id") % 8 + 1).cast("int")).alias("v"))
    return e.groupBy("v").agg(F.bool_and(T.truthy(F.col("v"))).alias("strict"), F.bool_and(T.truthy(F.col("v"), True)).alias("permissive"))


def timestamp_parse(spark, d):
    """Order dates as text, in four ways to write them, and as no date."""
    t = F.col("o_orderdate")
    seconds = F.unix_micros(t.cast("timestamp")) / 1_000_000
    ways = F.array(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(t, "yyyy/MM/dd HH:mm:ss"), seconds.cast("long").cast("string"), F.date_format(t, "yyyy-MM-dd HH:mm"), F.lit("never"))
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(ways, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("t"))
    return o.select("o_orderkey", F.unix_micros(records.timestamp(F.col("t"))).alias("us"))


#: What questions of plan_classify begin with.
PLANNED = ("", "user: ", "どんな 島 ", "明治 1899年 と 昭和、明治の 1899年 ", "比較 おすすめ ", "一覧 カフェー巡り ", "山田：行き方 について 詳しく ", "料金 の-時間 ", "概要 なに ")


def plan_classify(spark, d):
    """Questions of the conversations with words before them that change the plan, behind a sender's name in some."""
    said = F.array(*[F.lit(x) for x in PLANNED])
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.get(said, ((F.col("conv_id") + F.col("turn")) % len(PLANNED)).cast("int")), F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("text"))).alias("text"))
    p = q.select("conv_id", "turn", routing.answer_plan(F.col("text")).alias("p"))
    return p.select("conv_id", "turn", "p.kind", "p.style", *[F.array_join(f"p.{c}", ",").alias(c) for c in ("sections", "times", "keywords")])


def intent_detect(spark, d):
    """Questions as they are, and with words of an intent before them."""
    words = F.array(*[F.lit(w) for w in ("", "フェリーの", "Weather ", "viewpoint map ", "展望 台の地図 ")])
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.element_at(words, (F.col("conv_id") % 5 + 1).cast("int")), "text").alias("q"))
    return c.select("conv_id", "turn", routing.intent(F.col("q")).alias("intent"), F.array_join(answers.transport_sections(F.col("q")), ",").alias("sections"))


def message_split(spark, d):
    parts = T.split_message(F.col("text"), 300)
    return table(spark, d, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("parts"), F.md5(F.array_join("p", "\x01")).alias("md5"), F.size(T.pack_messages(F.col("p"), 900)).cast("long").alias("messages"))


def section_parse(spark, d):
    """Answers that are made of each whole passage: its words under headers, with bullets and numbers."""
    words = F.split(T.squeeze(F.col("text")), " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    rest = F.array_join(F.slice(words, F.lit(17), F.greatest(F.lit(0), F.size(words) - 16)), " ")
    answer = F.concat(F.lit("# 要約：\n"), part(1, 5), F.lit("\n\n"), part(6, 3), F.lit("\n### 詳細\n- "), part(9, 4), F.lit("\n2. "), part(13, 4), F.lit("\n補足\n・"), rest, F.lit("\n出典\nx"))
    s = table(spark, d, "benchmark").select("item_id", T.sections(answer).alias("s"))
    return s.select("item_id", "s.summary", F.array_join("s.details", "|").alias("details"), F.array_join("s.notes", "|").alias("notes"))


def keyword_enforce(spark, d):
    """Each passage's sentences as lines of a summary and details, kept where they name the passage's first word of five letters."""
    lines = F.array_join(F.transform(F.split("text", "(?<=[.!?]) "), lambda x: F.concat(F.lit("- "), x)), "\n")
    answer = F.concat(F.lit("### 要約\n"), lines, F.lit("\n### 詳細 \n\n- zzz\n\n### 出典\n- "), "text")
    key = F.slice(F.filter(T.question_keywords(F.col("text")), lambda w: F.length(w) == 5), 1, 1)
    return table(spark, d, "benchmark").select("item_id", F.md5(T.on_topic(answer, key)).alias("md5"), F.length(T.on_topic(answer, key)).cast("long").alias("chars"))


def entry_detail(spark, d):
    e = entries(spark, d).select("ord", F.concat(F.lit(" "), "title").alias("title"), F.replace("desc", F.lit(" "), F.lit("  ")).alias("desc"), "address", F.col("price").cast("int").cast("string").alias("price"), "tags", "areas")
    return e.select("ord", F.md5(answers.detail(dict(e.dtypes))).alias("md5"))


def source_footer(spark, d):
    sources = F.array(*[F.struct(F.when(F.col("item_id") % k == 0, F.concat(F.lit("note "), (F.col("item_id") % 2).cast("string"))).otherwise(" ").alias("note"), F.when(F.col("item_id") % 2 == 0, "http://x").otherwise("").alias("url")) for k in (1, 2, 3)])
    text = F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("— 出典 —"))).otherwise(F.concat("text", F.lit(" \n")))
    return table(spark, d, "benchmark").select("item_id", F.md5(answers.with_footer(text, sources)).alias("md5"))


def slot_lines(spark, d):
    e = entries(spark, d)
    line = answers.slot_line(F.when(F.col("ord") % 9 > 0, F.col("title")), F.col("areas")[0], F.substr("desc", F.lit(1), F.lit(80)), F.col("tags"), F.when(F.col("ord") % 2 == 0, "9-17"), F.when(F.col("ord") % 3 == 0, "http://x"))
    return e.select("ord", F.md5(line).alias("md5"))


def summary_bounds(spark, d):
    b = answers.summary_bounds(F.col("text"), least=550, most=800, fallback=300)
    return table(spark, d, "documents").select("doc_id", b.alias("b")).select("doc_id", F.col("b.min_chars").cast("long").alias("min_chars"), F.col("b.max_chars").cast("long").alias("max_chars"), "b.short")


def route_select(spark, d):
    e = table(spark, d, "events")
    r = routing.route(special=F.col("event_type") == "error", tourism=F.col("value") > 50, pamphlet=F.col("user_id") % 2 == 0)
    return e.groupBy(r.alias("route")).agg(F.count("*").alias("n"))


def vector_norms(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(records.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"), F.round(records.dot(records.unit(F.col("embedding")), records.unit(F.col("embedding"))), 6).alias("one"))


QUERIES = {f.__name__: f for f in (norm_text, split_list, tokens_regex, char_bigrams, sentence_split, chunk_windows, fragment_pack, lang_id, ttl_parse, label_extract, kana_fold, json_value, text_hashes, source_parts, coord_parse, url_host, truthy_values, timestamp_parse, plan_classify, intent_detect, message_split, section_parse, keyword_enforce, entry_detail, source_footer, slot_lines, summary_bounds, route_select, vector_norms)}

def _plan_sql() -> str:
    """The words of the plan are the fixed values that both sides need; the rules are written out."""
    words = lambda w: "regexp_matches(q, '" + "|".join(w) + "')"
    listed = lambda w: ", ".join(f"'{x}'" for x in w)
    said = listed(PLANNED)
    kinds = " ".join(f"WHEN {words(w)} THEN '{k}'" for k, w in routing.KINDS.items())
    return rf"""WITH a AS (SELECT conv_id, turn, regexp_replace([{said}][(conv_id + turn) % {len(PLANNED)} + 1] || CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role = 'user'),
        b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '^(?:[A-Za-z]+|[\pL\pN\pM_々〆ゝゞ]+)[:：]\s*', ''), '^\s+|\s+$', '', 'g') AS q FROM a),
        c AS (SELECT *, CASE {kinds} WHEN {words(routing.FACTS)} THEN 'fact' ELSE 'overview' END AS kind, CASE WHEN {words(routing.DETAILS)} THEN 'detailed' WHEN {words(routing.FACTS)} OR length(q) <= 15 AND {words(routing.ASKING)} THEN 'brief' ELSE 'normal' END AS style,
          list_filter(regexp_extract_all(regexp_replace(q, '[\s、。,.!?！？\-ー（）()\[\]【】『』]+', ' ', 'g'), '[A-Za-z0-9一-龠々〆ヵヶぁ-んァ-ンゝゞー]{{2,}}'), lambda w: w NOT IN ({listed([*routing.STOP, *routing.ASKING])})) AS k,
          list_concat(list_sort(list_distinct(regexp_extract_all(q, '{"|".join(routing.ERAS)}'))), list_sort(list_distinct(regexp_extract_all(q, '[0-9]{{3,4}}年')))) AS times FROM b)
        SELECT conv_id, turn, kind, style, CASE style WHEN 'brief' THEN '結論,補足' WHEN 'normal' THEN '結論,要点,補足' ELSE CASE kind WHEN 'howto' THEN '結論,手順,注意' ELSE '結論,要点,注意' END END AS sections, array_to_string(times, ',') AS times, array_to_string(k, ',') AS keywords FROM c"""


ORACLE_SQL = {
    "norm_text": r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM benchmark",
    "split_list": r"SELECT item_id, item FROM (SELECT item_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '[\n,]+')), '\s+', ' ', 'g')) AS item FROM benchmark) WHERE item <> ''",
    "tokens_regex": r"SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS token FROM benchmark) GROUP BY 1, 2",
    "char_bigrams": """WITH f AS (SELECT lower(p_name) AS low, replace(lower(p_name), ' ', '') AS flat FROM part), g AS (SELECT unnest(regexp_extract_all(low, '[a-z0-9]+')) AS gram FROM f
        UNION ALL SELECT substr(flat, i, 2) FROM (SELECT flat, unnest(range(1, length(flat))) AS i FROM f)) SELECT gram, count(*) AS n FROM g GROUP BY gram""",
    "sentence_split": r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([。．！？!?])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')) AS BIGINT) AS n FROM documents",
    "chunk_windows": r"""WITH w AS (SELECT doc_id, text AS body, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 700 THEN 1 ELSE CAST(ceil((length(text) - 700) / 550) AS BIGINT) + 1 END)) AS i FROM documents),
        c AS (SELECT doc_id, i, i * 550 AS char_start, least(i * 550 + 700, n) AS char_end, trim(regexp_replace(substr(body, i * 550 + 1, 700), '^\s+|\s+$', '', 'g')) AS t, body FROM w)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, char_start, char_end, length(substr(body, 1, char_start)) - length(replace(substr(body, 1, char_start), chr(10), '')) + 1 AS line_start,
        length(substr(body, 1, char_end)) - length(replace(substr(body, 1, char_end), chr(10), '')) + 1 AS line_end, md5(t) AS md5 FROM c WHERE t <> ''""",
    "lang_id": r"""WITH f AS (SELECT unnest([text, text || ' 交通', text || ' かな 交通', regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), '  ']) AS t, unnest(range(0, 5)) AS form FROM documents), s AS (SELECT form, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM f)
        SELECT form, CASE WHEN regexp_matches(t, '[ぁ-んァ-ン]') THEN 'ja' WHEN contains(t, '交通') THEN 'zh-Hant' WHEN regexp_full_match(t, '[A-Za-z0-9\s\-.,!?''"/()]+') THEN 'en' ELSE 'ja' END AS lang, count(*) AS n FROM s GROUP BY 1, 2""",
    "ttl_parse": "SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 60 WHEN 3 THEN 86400 WHEN 5 THEN 3600 END * CAST(l_linenumber AS BIGINT) AS seconds FROM lineitem",
    "label_extract": "SELECT item_id, (item_id % 7) || ',2' AS labels FROM benchmark",
    "kana_fold": "SELECT p_partkey, replace(lower(p_name), ' ', '') || ['かたかな', 'がいど', 'ゔぁいおりん', 'tokyo~', 'かけ'][p_partkey % 5 + 1] AS folded FROM part",
    "json_value": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "text_hashes": "SELECT event_id, sha1(user_id || ':' || event_type) AS text_key, sha256(CAST(user_id AS VARCHAR)) AS user_hash FROM events",
    "source_parts": "SELECT doc_id, source AS folder, CAST(doc_id AS VARCHAR) AS file, 'L1-9' AS lines FROM documents",
    "coord_parse": "SELECT s_suppkey, round(32 + (s_suppkey % 100) / 50, 4) AS lat, round(128 + (s_suppkey % 97) / 50, 4) AS lng FROM supplier",
    "url_host": "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
    "truthy_values": "SELECT * FROM (VALUES ('yes', true, true), ('off', false, false), ('TRUE', true, true), ('', false, false), ('maybe', false, true), ('t', false, true), ('null', false, true), ('2', false, true)) t(v, strict, permissive)",
    "timestamp_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN epoch_us(o_orderdate) END AS us FROM orders",
    "plan_classify": _plan_sql(),
    "intent_detect": """WITH c AS (SELECT conv_id, turn, ['', 'フェリーの', 'weather ', 'viewpoint map ', '展望 台の地図 '][conv_id % 5 + 1] || lower(text) AS q FROM conversations WHERE role = 'user'),
        s AS (SELECT *, contains(q, 'フェリー') AS ship, regexp_matches(replace(regexp_replace(q, '[ \\t\\n\\r]', '', 'g'), chr(11), ''), 'ana|jal|orc') AS fly FROM c)
        SELECT conv_id, turn, CASE WHEN contains(q, 'weather') THEN 'weather' WHEN contains(q, 'フェリー') OR regexp_matches(q, 'status|ana|jal|orc') THEN 'transport' WHEN regexp_matches(q, 'viewpoints?\\s*map|展望\\s*(?:所|台)?の?\\s*(?:マップ|地図)') AND NOT contains(q, '台の地図') THEN 'viewpoint_map' END AS intent,
          CASE WHEN ship AND NOT fly THEN 'ship' WHEN fly AND NOT ship THEN 'flight' ELSE 'ship,flight' END AS sections FROM s""",
    "section_parse": r"""WITH b AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark) SELECT item_id, array_to_string(w[1:5], ' ') || chr(10) || array_to_string(w[6:8], ' ') AS summary, array_to_string(w[9:12], ' ') || '|' || array_to_string(w[13:16], ' ') AS details, array_to_string(w[17:], ' ') AS notes FROM b""",
    "entry_detail": f"WITH {ENTRIES} SELECT ord, md5(title || chr(10) || descr || chr(10) || '料金：' || CAST(trunc(price) AS INT) || chr(10) || 'タグ：' || tags[1] || ' / ' || tags[2] || chr(10) || 'エリア：' || areas[1]) AS md5 FROM e",
    "source_footer": r"""WITH b AS (SELECT item_id, text, 'note ' || (item_id % 2) || CASE WHEN item_id % 2 = 0 THEN ' http://x' ELSE '' END AS note FROM benchmark) SELECT item_id, md5(CASE WHEN item_id % 7 = 0 THEN text || '— 出典 —' ELSE regexp_replace(text || ' ', '\s+$', '') || chr(10) || chr(10) || '— 出典 —' || chr(10) || '・' || note END) AS md5 FROM b""",
    "slot_lines": f"WITH {ENTRIES} SELECT ord, md5('・' || CASE WHEN ord % 9 > 0 THEN title ELSE '（名称不明）' END || '（' || areas[1] || '）— ' || substr(descr, 1, 80) || '｜' || tags[1] || ' / ' || tags[2] || CASE WHEN ord % 2 = 0 THEN '｜9-17' ELSE '' END || CASE WHEN ord % 3 = 0 THEN chr(10) || '  http://x' ELSE '' END) AS md5 FROM e",
    "summary_bounds": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), s AS (SELECT doc_id, length(t) <= 600 OR length(t) - length(replace(t, chr(10), '')) + 1 <= 2 AS short FROM t)
        SELECT doc_id, CASE WHEN short THEN 300 ELSE 550 END::BIGINT AS min_chars, CASE WHEN short THEN 500 ELSE 800 END::BIGINT AS max_chars, short FROM s""",
    "route_select": "SELECT CASE WHEN event_type = 'error' THEN 'special' WHEN value > 50 THEN 'tourism' WHEN user_id % 2 = 0 THEN 'pamphlet' ELSE 'no_answer' END AS route, count(*) AS n FROM events GROUP BY 1",
    "vector_norms": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squared, 1.0::DOUBLE AS one FROM embeddings",
}
