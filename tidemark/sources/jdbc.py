"""Database tables over JDBC, read in parallel when a numeric or time column splits them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcSplit:
    """Range split of one read into ``partitions`` queries; rows outside the bounds
    still land in the first and last one."""

    column: str
    lower: object
    upper: object
    partitions: int

    def options(self) -> dict[str, str]:
        if self.partitions < 1:
            raise ValueError("a split needs at least one partition")
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    split: JdbcSplit | None = None,
    fetch_size: int = 10_000,
    **connection: str,
) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``; a query wins over a table, as a subquery,
    so that predicates and splits apply to its result whatever clauses it holds."""
    if not table and not query:
        raise ValueError("a JDBC source needs a table or a query")
    options = {"url": url, "fetchsize": str(fetch_size), **connection}
    options["dbtable"] = f"({query}) AS q" if query else str(table)
    if split:
        options.update(split.options())
    return options


def jdbc_scan(spark: SparkSession, **options) -> DataFrame:
    """Typed columns as the database reports them. Filters put on the result, such as the
    high-water mark, and the column list are pushed into the database's own query."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()
