"""The queries of the engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import documents, tables, turns


def _all() -> list[tuple[Callable, str | None]]:
    return [*tables.QUERIES, *documents.QUERIES, *turns.QUERIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _all() if sql}
