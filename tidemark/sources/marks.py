"""High-water marks: what a refresh reads, skips and remembers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import as_instant
from tidemark.sources.csv import CORRUPT


def instant_literal(moment: datetime) -> Column:
    """NTZ literal of a driver-side moment; an aware one is taken to UTC first."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def mark_of(df: DataFrame, column: str) -> Column:
    return as_instant(F.col(column), df.schema[column].dataType)


def _compared(df: DataFrame, column: str, mark: datetime) -> tuple[Column, Column]:
    """Column and literal of a type the scan can compare by itself, so that the filter is
    pushed into it; text is parsed first. A date is past a mark when it is past its day."""
    dtype = df.schema[column].dataType
    literal = instant_literal(mark)
    if isinstance(dtype, T.TimestampType):
        return F.col(column), literal.cast("timestamp")
    if isinstance(dtype, T.DateType):
        return F.col(column), literal.cast("date")
    return as_instant(F.col(column), dtype), literal


def effective_mark(since: datetime | None, stored: datetime | None) -> datetime | None:
    """An explicit ``since`` replaces the stored mark of every source of the run."""
    return since if since is not None else stored


def incremental_filter(df: DataFrame, column: str | None, mark: datetime | None) -> DataFrame:
    """Rows strictly past the mark. Unreadable values drop out once a mark is set and stay in
    (to be reported) while there is none. Malformed records always stay: where one stands
    cannot be told, and it makes the whole batch unusable."""
    if column is None or mark is None:
        return df
    value, bound = _compared(df, column, mark)
    past = value > bound
    return df.filter(past | F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else past)


def late_rows(df: DataFrame, column: str, mark: datetime) -> DataFrame:
    """Rows at or below the mark, which a refresh skips."""
    value, bound = _compared(df, column, mark)
    return df.filter(value <= bound)


def batch_high_water_mark(df: DataFrame, column: str) -> DataFrame:
    """One row: the latest readable mark of the batch, NULL when there is none."""
    return df.agg(F.max(mark_of(df, column)).alias("high_water_mark"))


def order_by_watermark(df: DataFrame, column: str) -> DataFrame:
    """Presentation order. Writers use ``sortWithinPartitions``, which needs no shuffle."""
    return df.orderBy(mark_of(df, column).asc())
