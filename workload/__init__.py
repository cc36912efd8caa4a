"""The queries of ``__spark_entry__``: each operator of the package over the given tables,
next to the SQL that states the expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql:
            EXPECTED[name] = sql
        return run

    return add


def load_all() -> None:
    from workload import backdated, commits, dimensions, extract, indexes, jobs, quality, star, state, streams  # noqa: F401
