"""Operators for preparing training text at scale, and the queries that apply them to the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from chronoloom.llm import queries

    return dict(queries.QUERIES)


def all_sql() -> dict[str, str]:
    from chronoloom.llm import queries

    return dict(queries.SQL)
