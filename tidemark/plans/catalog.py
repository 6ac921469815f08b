"""All queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import daily_queries, graph_queries, other_queries, quality_queries, stream_queries

_ALL = daily_queries.QUERIES | quality_queries.QUERIES | other_queries.QUERIES | graph_queries.QUERIES | stream_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
