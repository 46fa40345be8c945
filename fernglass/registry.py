"""All queries of the library by name, and the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernglass.plans import entry_queries, guard_queries, log_queries, retrieval_queries, text_queries

_PARTS = (log_queries, text_queries, entry_queries, retrieval_queries, guard_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
