"""The queries of the training-data operators over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm import clustering, common, fingerprint, html_extract, line_dedup, minhash, mixing, packing, quality_rules, suffix_dedup, token_alignment, token_counts, token_orc, toxicity


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer(), end_id=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    path = common.scratch(spark, "orc")
    token_orc.write_token_orc(_table(spark, sf_dir, "documents"), path, tokenizer(), end_id=1)
    return token_orc.token_digests(spark, path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality_rules.judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_report(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(spark, *clustering.cluster(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_fingerprint": op3_fingerprint,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_token_orc": op6_token_orc,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash": op9_minhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_centroids": op13_centroids,
}


def _centroid_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """Rounds as tables that follow each other, each with the centroids so far."""
    square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))"
    steps = [f"""
q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 524288)) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (
    SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM q ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT vec_id, q_v, s // {k} AS distance, CAST(s % {k} AS INTEGER) AS cluster FROM (
    SELECT q.vec_id, any_value(q.v) AS q_v, CAST(min({square} * {k} + c.cluster) AS BIGINT) AS s FROM q, c{r} c GROUP BY q.vec_id))""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT cluster, list(CAST(m AS BIGINT) ORDER BY i) AS v FROM (
    SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT cluster, unnest(q_v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)""")
    return "WITH" + ",".join(steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""

ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL AND g.first_doc <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE g.key IS NULL OR g.first_doc = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN g ON g.key = k.key GROUP BY k.doc_id
""",
    "op13_centroids": _centroid_sql(),
}
