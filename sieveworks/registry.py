"""All queries of the library's own operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import document_queries, gate_queries, inventory_queries, join_queries, rank_queries, series_queries, source_queries, step_queries, step_tables, text_queries, web_queries

_PLANS = (rank_queries, series_queries, web_queries, gate_queries, text_queries, source_queries, inventory_queries, step_queries, step_tables, join_queries, document_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
