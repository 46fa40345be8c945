"""Queries over document windows, vectors, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import index
from fernglass.operators import retrieval as R
from fernglass.session import scratch, table, written

_tokens = lambda c: T.word_tokens(c)


def _chunks(spark, d):
    return R.chunk(table(spark, d, "documents"), part="lang", doc="doc_id", text="text")


_NAMES = {"part": "lang", "doc": "doc_id", "text": "text"}


def tfidf_df_idf(spark, d):
    return R.idf(table(spark, d, "documents"), _tokens, **_NAMES).select("part", "term", "df", F.round("idf", 6).alias("idf"))


def tfidf_topk(spark, d):
    docs = table(spark, d, "documents")
    p = written(R.postings(docs, _tokens, marks=True, **_NAMES), "postings")
    q = spark.createDataFrame([(1, "en", "the thing of that"), (2, "fr", "que pour la pour"), (3, "de", "und nowhereword")], "qid long, part string, query string")
    return R.tfidf_search(p, R.weights(p), q, _tokens, k=5).select("qid", "doc", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"))


def index_changes(spark, d):
    """An index of all documents, of which those of low quality then go and every seventh gets another text; it is asked after that."""
    docs, path = table(spark, d, "documents").select("lang", "doc_id", "text"), scratch(spark, "index")
    index.change(spark, path, docs, _tokens, **_NAMES)
    low = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("doc"))
    new = docs.where("doc_id % 7 = 0").join(low, F.col("doc_id") == F.col("doc"), "left_anti").withColumn("text", F.concat(F.lit("the thing that was changed\n"), "text"))
    index.change(spark, path, new, _tokens, removed=low, **_NAMES)
    q = spark.createDataFrame([(1, "en", "the thing of that"), (2, "fr", "que pour la pour"), (3, "de", "und nowhereword"), (4, "en", "changed")], "qid long, part string, query string")
    return index.search(index.read(spark, path), q, _tokens, k=5).select("qid", "doc", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"))


def _near(spark, d, k=24):
    """The vectors nearest to every twentieth one, among all."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return R.dense_search(v, q, key="vec_id", vector="embedding", k=k)


def dense_topk(spark, d):
    return _near(spark, d).select("qid", "key", F.round("score", 5).alias("score"))


def rrf_fusion(spark, d):
    """The nearest vectors of each query fused with the first 24 by label, a list that all queries share."""
    v = table(spark, d, "embeddings")
    near = _near(spark, d)
    listed = v.select(F.col("vec_id").alias("key"), F.col("label").cast("double").alias("score")).orderBy(F.desc("score"), "key").limit(24)
    two = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid")).crossJoin(F.broadcast(listed)).select("qid", F.lit("label").alias("list"), "key", "score")
    return R.fuse(near.select("qid", F.lit("dense").alias("list"), "key", "score").unionByName(two)).select("qid", "key", F.round("score", 6).alias("score"))


def mmr_select(spark, d):
    v = table(spark, d, "embeddings")
    c = _near(spark, d, 12).join(v, F.col("key") == F.col("vec_id")).select("qid", "key", F.col("score").alias("rel"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return R.diversify(c)


def _near_files(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("file"))
    return _near(spark, d, 8).join(v, F.col("key") == F.col("vec_id")).select("qid", "file", "score", "key")


def confidence(spark, d):
    return R.confidence(_near_files(spark, d)).select("qid", F.round("confidence", 5).alias("confidence"))


def retry_weak(spark, d):
    """Queries whose own vector is the only pick of a likeness above a half, and whose confidence is low."""
    return R.weak(_near_files(spark, d).where("score > 0.5"), least=2, below=0.9999)


def reused_success(spark, d):
    """Events as attempts at questions, some in capitals or with more spaces; two thirds of the documents are there to be used again."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    attempts = e.select(n.alias("id"), F.col("event_type").alias("place"), F.concat(F.when(n % 2 == 0, "Which  ").otherwise(" which "), (F.col("user_id") % 7).cast("string")).alias("question"), "ts", (F.col("value") > 60).alias("success"), F.array(*[(n * k) % 200 for k in (1, 3, 7, 11, 13)]).alias("keys"))
    chunks = e.select(F.col("event_type").alias("place")).distinct().join(table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key")))
    return R.reused_success(attempts, chunks, ttl_seconds=6 * 3600).select("id", "since_us", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"))


def scope_filter(spark, d):
    e = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("qid"), F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("score"), "text")
    style = F.element_at(F.array(F.lit("brief"), F.lit("normal"), F.lit("detailed")), (F.col("qid") % 3 + 1).cast("int"))
    return R.in_scope(e.withColumn("kw", F.array(F.lit("idiot"), F.lit("Worthless"), F.lit(""))).withColumn("style", style), text="text", keywords="kw", style="style").select("qid", "key")


def context_labels(spark, d):
    s = _chunks(spark, d).select(F.col("doc").alias("qid"), (F.col("chunk_index") + 1).alias("pick"), F.col("part").alias("place"), F.concat(F.lit("d"), F.col("doc").cast("string"), F.when(F.col("doc") % 3 == 0, ".TXT").when(F.col("doc") % 3 == 1, ".md").otherwise(".csv")).alias("file"), "line_start", "line_end", "text")
    return R.labelled_context(s).select("qid", F.md5("context").alias("md5"))


def _answers(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.concat(F.lit("first part [[1]] "), "text", F.lit(" [[2]] and then more of it [[1]] nothing [["), (F.col("item_id") % 5).cast("string"), F.lit("]]")).alias("answer"))


def _refs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("label"))
    return b.select("item_id", "label", (F.col("label") % 2).cast("long").alias("doc"), (F.col("label") / 10).cast("double").alias("score"))


def citation_aggregate(spark, d):
    s = R.cited_segments(_answers(spark, d), key="item_id", answer="answer")
    return R.citations(s, _refs(spark, d), key="item_id", least_chars=8, least_score=0.6).select("item_id", "doc", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "chars", F.round("score", 6).alias("score"))


def rebuilt_answers(spark, d):
    """Answers that cite two documents, one of which often says and weighs too little, and labels that mean nothing."""
    said = F.concat(F.lit("First part [[1]] "), "text", F.lit(" [[2]] and then more of it[[1]] nothing [["), (F.col("item_id") % 5).cast("string"), F.lit("]] at the end "))
    b = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 3, F.lit(" no label at all ")).otherwise(said).alias("answer"))
    got = R.rebuilt_answers(b, _refs(spark, d), key="item_id", answer="answer", least_chars=200, least_score=0.45)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return got.select("item_id", F.md5("labelled").alias("labelled"), F.md5("plain").alias("plain"), joined("used"), joined("invalid"))


def unknown_labels(spark, d):
    return R.unknown_labels(R.cited_segments(_answers(spark, d), key="item_id", answer="answer"), _refs(spark, d), key="item_id").select("item_id", F.col("label").cast("long").alias("label"))


def semi_cited(spark, d):
    cited = table(spark, d, "labels").where("quality = 1 and toxic = 0")
    return table(spark, d, "documents").join(cited, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


def extractive_summary(spark, d):
    docs = table(spark, d, "benchmark").withColumn("t", F.regexp_replace("text", r"\. ?", "! "))
    return R.extractive_summary(docs, ["The", "that"], key="item_id", text="t").select("item_id", F.length("summary").cast("long").alias("chars"), F.md5("summary").alias("md5"))


def model_tier(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", R.model_tier(F.col("value") / 100, F.col("user_id") % 8, F.col("event_id") % 4).alias("tier"))


def file_changes(spark, d):
    """Orders by their date beside what lineitem knows of them, by its latest shipment."""
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.max("l_shipdate").alias("mtime"))
    return R.file_changes(old, new)


QUERIES = {f.__name__: f for f in (tfidf_df_idf, tfidf_topk, index_changes, dense_topk, rrf_fusion, mmr_select, confidence, retry_weak, reused_success, scope_filter, context_labels, citation_aggregate, rebuilt_answers, unknown_labels, semi_cited, extractive_summary, model_tier, file_changes)}

_CHUNKS = r"""w AS (SELECT lang, doc_id, text AS body, length(text) AS n, unnest(range(0, CASE WHEN length(text) <= 700 THEN 1 ELSE CAST(ceil((length(text) - 700) / 550) AS BIGINT) + 1 END)) AS i FROM documents),
  c0 AS (SELECT lang, doc_id, i, i * 550 AS cs, least(i * 550 + 700, n) AS ce, trim(regexp_replace(substr(body, i * 550 + 1, 700), '^\s+|\s+$', '', 'g')) AS t, body FROM w),
  c AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ci, t, length(substr(body, 1, cs)) - length(replace(substr(body, 1, cs), chr(10), '')) + 1 AS ls, length(substr(body, 1, ce)) - length(replace(substr(body, 1, ce), chr(10), '')) + 1 AS le FROM c0 WHERE t <> ''),
  p AS (SELECT lang, doc_id, ci, term, count(*) AS tf FROM (SELECT lang, doc_id, ci, unnest(regexp_extract_all(lower(t), '[\pL\pN_]+')) AS term FROM c) GROUP BY ALL),
  n AS (SELECT lang, count(*) AS n FROM c GROUP BY lang), f AS (SELECT p.lang, term, count(*) AS df, ln((any_value(n.n) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM p JOIN n ON n.lang = p.lang GROUP BY p.lang, term)"""
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings), s AS (SELECT q.vec_id AS qid, v.vec_id AS key, v.label, round(list_inner_product(v.u, q.u), 9) AS score FROM v, v q WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS r FROM s)"
_SEG = "a AS (SELECT item_id, text AS x, item_id % 5 AS m FROM benchmark), g AS (SELECT item_id, 1 AS label, 'first part' AS seg FROM a UNION ALL SELECT item_id, 2, trim(x, ' ') FROM a UNION ALL SELECT item_id, 1, 'and then more of it' FROM a UNION ALL SELECT item_id, m, 'nothing' FROM a)"
_CONF = "t AS (SELECT qid, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS r2 FROM k WHERE r <= 8{more}), f AS (SELECT qid, 0.5 * count(DISTINCT label) / count(*) + 0.5 * least(1.0, avg(greatest(0.0, score))) AS c FROM t WHERE r2 <= 4 GROUP BY qid)"

def _topk_sql(docs: str, more: str) -> str:
    now = """now AS (SELECT lang, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'the thing that was changed' || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), """
    return f"""WITH {now}{_CHUNKS.replace('FROM documents', 'FROM ' + docs)}, x AS (SELECT p.*, tf * idf AS v FROM p JOIN f ON f.lang = p.lang AND f.term = p.term), m AS (SELECT lang, doc_id, ci, sqrt(sum(v * v)) AS norm FROM x GROUP BY ALL),
        q0 AS (SELECT * FROM (VALUES (1::BIGINT, 'en', 'the', 1), (1, 'en', 'thing', 1), (1, 'en', 'of', 1), (1, 'en', 'that', 1), (2, 'fr', 'que', 1), (2, 'fr', 'pour', 2), (2, 'fr', 'la', 1), (3, 'de', 'und', 1), (3, 'de', 'nowhereword', 1){more}) t(qid, lang, term, tf)),
        q AS (SELECT qid, q0.lang, q0.term, tf * idf AS qv FROM q0 JOIN f ON f.lang = q0.lang AND f.term = q0.term), qn AS (SELECT qid, sqrt(sum(qv * qv)) AS qnorm FROM q GROUP BY qid),
        dt AS (SELECT qid, x.lang, doc_id, ci, sum(v * qv) AS dot FROM x JOIN q ON q.lang = x.lang AND q.term = x.term GROUP BY ALL)
        SELECT qid, doc, chunk_index, round(sc, 6) AS score FROM (SELECT dt.qid, dt.doc_id AS doc, dt.ci AS chunk_index, round(dot / (norm * qnorm), 9) AS sc FROM dt JOIN m ON m.doc_id = dt.doc_id AND m.ci = dt.ci JOIN qn ON qn.qid = dt.qid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sc DESC, doc, chunk_index) <= 5"""


ORACLE_SQL = {
    "tfidf_df_idf": f"WITH {_CHUNKS} SELECT lang AS part, term, df, round(idf, 6) AS idf FROM f",
    "tfidf_topk": _topk_sql("documents", ""),
    "index_changes": _topk_sql("now", ", (4, 'en', 'changed', 1)"),
    "dense_topk": f"WITH {_V} SELECT qid, key, round(score, 5) AS score FROM k WHERE r <= 24",
    "rrf_fusion": f"""WITH {_V}, b AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings), l AS (SELECT qid, key, r FROM k WHERE r <= 24 UNION ALL SELECT q.vec_id, b.vec_id, r FROM b, embeddings q WHERE r <= 24 AND q.vec_id % 20 = 0),
        u AS (SELECT qid, key, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM l GROUP BY qid, key) SELECT qid, key, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) <= 12""",
    "confidence": f"WITH {_V}, {_CONF.format(more='')} SELECT qid, round(c, 5) AS confidence FROM f",
    "retry_weak": f"WITH {_V}, {_CONF.format(more=' AND score > 0.5')}, n AS (SELECT qid, count(*) AS n FROM t GROUP BY qid) SELECT qid, n < 2 AND c < 0.9999 AS retry FROM f JOIN n USING (qid)",
    "reused_success": """WITH a AS (SELECT event_id AS id, event_type AS place, user_id % 7 AS q, epoch_us(ts) AS t, value > 60 AS ok, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY ts, event_id) AS o, [event_id % 200, event_id * 3 % 200, event_id * 7 % 200, event_id * 11 % 200] AS keys FROM events),
        f AS (SELECT a.id, a.t - s.t AS since_us, s.keys FROM a ASOF JOIN (SELECT * FROM a WHERE ok) s ON a.place = s.place AND a.q = s.q AND a.o > s.o WHERE NOT coalesce(a.ok, false) AND a.t - s.t <= 6 * 3600 * 1000000::BIGINT),
        k AS (SELECT id, since_us, unnest(keys) AS key, generate_subscripts(keys, 1) AS p FROM f)
        SELECT id, since_us, string_agg(key, ',' ORDER BY p) AS keys FROM k WHERE key IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) GROUP BY id, since_us""",
    "scope_filter": """WITH e AS (SELECT doc_id % 20 AS qid, doc_id AS key, n_chars AS score, contains(text, 'idiot') OR contains(text, 'Worthless') AS m FROM documents), g AS (SELECT *, bool_or(m) OVER (PARTITION BY qid) AS hits FROM e QUALIFY m OR NOT bool_or(m) OVER (PARTITION BY qid))
        SELECT qid, key FROM g QUALIFY NOT hits OR row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) <= CASE qid % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 8 END""",
    "context_labels": f"WITH {_CHUNKS} SELECT doc_id AS qid, md5(string_agg('[[' || (ci + 1) || ']] ' || lang || '/d' || doc_id || CASE WHEN doc_id % 3 = 2 THEN '.csv' ELSE '' END || ' L' || ls || '-' || le || chr(10) || t, chr(10) || chr(10) ORDER BY ci)) AS md5 FROM c GROUP BY doc_id",
    "citation_aggregate": f"""WITH {_SEG}, j AS (SELECT item_id, label, label % 2 AS doc, length(seg) AS n, label / 10 AS score FROM g WHERE label BETWEEN 1 AND 3)
        SELECT item_id, doc, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CAST(sum(n) AS BIGINT) AS chars, round(sum(score), 6) AS score FROM j GROUP BY item_id, doc HAVING sum(n) >= 8 OR sum(score) >= 0.6""",
    "rebuilt_answers": """WITH b AS (SELECT item_id, text AS x, item_id % 5 AS m FROM benchmark WHERE item_id % 4 <> 3), g AS (SELECT item_id, 1 AS p, 1 AS label, 'First part ' AS seg FROM b UNION ALL SELECT item_id, 2, 2, ' ' || x || ' ' FROM b UNION ALL SELECT item_id, 3, 1, ' and then more of it' FROM b UNION ALL SELECT item_id, 4, m, ' nothing ' FROM b),
        k AS (SELECT *, label BETWEEN 1 AND 3 AS known, label % 2 AS doc FROM g), d AS (SELECT item_id, doc, min(p) AS f, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM k WHERE known GROUP BY ALL HAVING sum(length(trim(seg, ' '||chr(10)))) >= 200 OR sum(label / 10) >= 0.45),
        a AS (SELECT k.item_id, trim(string_agg(seg || '[[' || label || ']]', '' ORDER BY p) FILTER (WHERE known AND d.doc IS NOT NULL), ' '||chr(10)) AS hm, trim(string_agg(seg, '' ORDER BY p) FILTER (WHERE known AND d.doc IS NOT NULL), ' '||chr(10)) AS hp, coalesce(string_agg(seg, '' ORDER BY p) FILTER (WHERE known), '') AS kp, coalesce(string_agg(label, ',' ORDER BY p) FILTER (WHERE NOT known), '') AS invalid
          FROM k LEFT JOIN d ON d.item_id = k.item_id AND d.doc = k.doc GROUP BY k.item_id), u AS (SELECT item_id, string_agg(labels, ',' ORDER BY f) AS used FROM d GROUP BY item_id)
        SELECT a.item_id, md5(coalesce(hm, '')) AS labelled, md5(CASE WHEN hm IS NULL THEN trim(kp || ' at the end ', ' '||chr(10)) || '（注：根拠ラベルが見つかりませんでした）' ELSE hp END) AS plain, CASE WHEN hm IS NULL THEN '' ELSE used END AS used, invalid FROM a LEFT JOIN u ON u.item_id = a.item_id
        UNION ALL SELECT item_id, md5(''), md5('no label at all（注：根拠ラベルが見つかりませんでした）'), '', '' FROM benchmark WHERE item_id % 4 = 3""",
    "unknown_labels": f"WITH {_SEG} SELECT DISTINCT item_id, label FROM g WHERE label NOT BETWEEN 1 AND 3",
    "semi_cited": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) GROUP BY lang",
    "extractive_summary": r"""WITH b AS (SELECT item_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\. ?', '! ', 'g'), '[\r\n]', ' ', 'g'), '([。！？!?])', '\1' || chr(1), 'g'), chr(1)) AS ss FROM benchmark),
        s0 AS (SELECT item_id, unnest(ss) AS raw, generate_subscripts(ss, 1) AS p FROM b), s AS (SELECT item_id, p, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM s0 WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''),
        k AS (SELECT *, CASE WHEN contains(s, 'The') THEN 3 ELSE 0 END + CASE WHEN contains(s, 'that') THEN 4 ELSE 0 END AS score FROM s), m AS (SELECT *, max(score) OVER (PARTITION BY item_id) > 0 AS anyk FROM k),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN anyk THEN CAST(score > 0 AS INT) ELSE score END DESC, CASE WHEN NOT anyk THEN length(s) END, p) AS r FROM m), j AS (SELECT item_id, substr(string_agg(s, chr(10) ORDER BY p), 1, 800) AS summary FROM r WHERE r <= 2 AND (score > 0 OR NOT anyk) GROUP BY item_id)
        SELECT item_id, length(summary) AS chars, md5(summary) AS md5 FROM j""",
    "model_tier": "SELECT event_id, CASE WHEN value / 100 < 0.75 OR user_id % 8 >= 6 OR event_id % 4 >= 2 THEN 'large' ELSE 'small' END AS tier FROM events",
    "file_changes": "WITH n AS (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1), b AS (SELECT coalesce(o_orderkey, l_orderkey) AS path, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN l_orderkey IS NULL THEN 'removed' WHEN m > o_orderdate THEN 'changed' END AS change FROM orders FULL JOIN n ON o_orderkey = l_orderkey) SELECT path, change FROM b WHERE change IS NOT NULL",
}
