"""Key-checked inserts and table reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.naming import all_of, member_of
from tidemark.operators.staging import first_per_key
from tidemark.sources.marks import instant_literal


def absent_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows an insert with "on conflict do nothing" adds: the first row of each key of
    the batch whose key the target lacks.

    The target is cut to the keys of the batch first. That side can be broadcast when
    the batch is small, and then a huge target is scanned in place, never shuffled.
    """
    fresh = first_per_key(batch, keys, order)
    asked = batch.select(*keys).distinct()
    known = member_of(target.select(*keys), asked, keys, "left_semi").distinct()
    return member_of(fresh, known, keys, "left_anti")


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    return target.unionByName(absent_rows(target, batch, keys, order))


def table_scan_eq(table: DataFrame, filters: Mapping[str, object] | None = None) -> DataFrame:
    """Rows that equal every given value; NULL equals NULL. Moments are UTC, or aware ones."""
    literals = {c: instant_literal(v) if isinstance(v, datetime) else F.lit(v) for c, v in (filters or {}).items()}
    return table.filter(all_of([F.col(c).eqNullSafe(v) for c, v in literals.items()]))


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name`` and ``row_count`` of every table."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    if not frames:
        raise ValueError("no tables given")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
