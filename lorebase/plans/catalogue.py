"""The query catalogue of the core: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from lorebase.plans import queries_knowledge, queries_references, queries_stages, queries_text  # noqa: F401

    return QUERIES, SQL
