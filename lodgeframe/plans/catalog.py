"""Registered queries: each runs an operator over whole tables, with the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodgeframe.plans import booking_queries, read_queries, replication_queries, search_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [read_queries, search_queries, booking_queries, replication_queries, stream_queries]


def queries() -> dict[str, Query]:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
