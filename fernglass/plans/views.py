"""The test tables seen as catalogue entries, question log and queries; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.session import table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("desc"), F.array("p_brand", "p_type").alias("tags"),
        F.array(F.concat(F.lit("area"), (F.col("p_size") % 5).cast("string"))).alias("areas"), F.col("p_type").alias("category"), F.lit("").alias("address"), F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("updated"), F.lit("").alias("holiday"), F.concat(F.lit("area"), (F.col("p_size") % 5).cast("string")).alias("city"),
        (32 + (F.col("p_partkey") % 100) / 50).alias("lat"), (128 + (F.col("p_partkey") % 97) / 50).alias("lng"),
    )


ENTRIES = """e AS (SELECT p_partkey AS ord, p_name AS title, p_type || ' ' || p_brand AS descr, [p_brand, p_type] AS tags, ['area' || (p_size % 5)] AS areas,
  p_type AS category, p_retailprice AS price, p_size AS updated, 'area' || (p_size % 5) AS city, 32 + (p_partkey % 100) / 50 AS lat, 128 + (p_partkey % 97) / 50 AS lng FROM part)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ord"), "ts", "user_id", F.col("event_type").alias("source"), F.concat(F.lit("q"), F.get_json_object("props", "$.k")).alias("question"), (F.col("event_type") != "error").alias("hit"), "value")


LOG = """l AS (SELECT event_id AS ord, ts, user_id, event_type AS source, 'q' || json_extract_string(props, '$.k') AS question, event_type <> 'error' AS hit, value FROM events)"""


def queries(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "qid long, query string")
