"""Raw value to contract type. Nothing here raises: bad input becomes NULL.

Sources deliver text (CSV, JSON) or typed columns (JDBC, Parquet); a column that
already has the right type is passed through without a text round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A decimal literal, and the year every accepted date text starts with.
# The casts alone would also take "1d", "inf" and a bare time of day.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATED_TEXT = r"^\s*[0-9]{4}"


# Fixed value: milliseconds from the epoch that a date may lie away from it.
MOST_MILLIS = 8_640_000_000_000_000


def is_json(dtype: T.DataType) -> bool:
    """Whether a column holds JSON values that still know their type."""
    return isinstance(dtype, T.VariantType)


def json_kind(c: Column) -> Column:
    """Name of a JSON value's type."""
    kind = F.schema_of_variant(c)
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def json_text(c: Column) -> Column:
    return F.try_variant_get(c, "$", "string")


def _if_json(c: Column, kind: str, value: Column) -> Column:
    return F.when(json_kind(c) == kind, value)


def as_key(c: Column, dtype: T.DataType) -> Column:
    return F.when(json_kind(c).isin("string", "number"), json_text(c)) if is_json(dtype) else as_text(c, dtype)


def as_text(c: Column, dtype: T.DataType) -> Column:
    if is_json(dtype):
        return _if_json(c, "string", json_text(c))
    return c if isinstance(dtype, T.StringType) else c.cast("string")


def as_number(c: Column, dtype: T.DataType) -> Column:
    if is_json(dtype):
        return _if_json(c, "number", F.try_variant_get(c, "$", "double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    parsed = c.try_cast("double")
    return F.when(c.rlike(NUMBER_TEXT) & (F.abs(parsed) < F.lit(float("inf"))), parsed)


def _from_millis(c: Column) -> Column:
    """Milliseconds since the epoch as a moment; fractions are cut off."""
    near = F.abs(c) <= F.lit(float(MOST_MILLIS))
    return F.when(near, F.timestamp_millis(F.when(near, c).cast("bigint"))).cast("timestamp_ntz")


def as_instant(c: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP_NTZ in the session zone (UTC); text with an offset is shifted to it, a
    number counts milliseconds."""
    if is_json(dtype):
        text = as_instant(_if_json(c, "string", json_text(c)), T.StringType())
        return F.coalesce(text, _from_millis(as_number(c, dtype)))
    if isinstance(dtype, T.NumericType):
        return _from_millis(c.cast("double"))
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    return F.when(c.rlike(DATED_TEXT), c.try_cast("timestamp")).cast("timestamp_ntz")


def as_flag(c: Column, dtype: T.DataType) -> Column:
    if is_json(dtype):
        return _if_json(c, "boolean", F.try_variant_get(c, "$", "boolean"))
    if isinstance(dtype, T.BooleanType):
        return c
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("boolean")
    return F.when(F.lower(F.trim(c)).isin("true", "false"), c.try_cast("boolean"))
