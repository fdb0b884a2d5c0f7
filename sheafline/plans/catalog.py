"""The catalogue of registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafline.plans import order_queries, structure_queries, table_queries, text_queries, update_queries

ALL = table_queries.QUERIES | text_queries.QUERIES | structure_queries.QUERIES | update_queries.QUERIES | order_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
