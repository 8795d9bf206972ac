"""Registered queries: name to (Spark query, SQL of the oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Inventory ids that each query covers.
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name], COVERS[name] = f, covers
        if sql:
            SQL[name] = sql
        return f

    return register


def load() -> None:
    from tessera.plans import arrays, evaluation, further, more, parsing, texts, workflow  # noqa: F401
