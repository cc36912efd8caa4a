"""Landed JSON responses and JSON text columns as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.csv import CORRUPT


def json_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per landed response file, the body in column ``body``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


# Larger bodies may not fit into one value, which cannot be told from text that is no JSON.
LARGE_BODY = 16 << 20


def json_records(spark: SparkSession, path: str | list[str], fields: Sequence[str], lines: bool = True) -> DataFrame:
    """Records of landed files, a JSON value for each field and ``_corrupt``: one record a
    line, in files that Spark splits, or else an array (or one record) per file, which is read
    as a stream of records however long it is. JSON null is NULL."""
    schema = T.StructType([T.StructField(f, T.VariantType()) for f in fields] + [T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(schema).json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return raw.select(*[_or_null(F.col(f)).alias(f) for f in fields], CORRUPT)


def _or_null(value: Column) -> Column:
    return F.when(~F.is_variant_null(value), value)


def _step(node: Column, key: str) -> Column:
    quoted = key.replace("'", "\\'")
    found = F.try_variant_get(node, f"$['{quoted}']", "variant")
    if key.isdigit():
        found = F.coalesce(found, F.try_variant_get(node, f"$[{key}]", "variant"))
    return found


def json_path_rows(
    df: DataFrame,
    body: str,
    data_path: str | None = None,
    fields: Sequence[str] = (),
    value_column: str | None = None,
    keep: Sequence[str] = (),
    report_corrupt: bool = False,
    typed: bool = False,
) -> DataFrame:
    """Records found at a dotted path: an array gives one row per element, any other value
    one row, a missing path none. Record fields come out as strings, or with ``typed`` as
    JSON values whose type the contract checks; ``value_column`` keeps the record itself as
    text (scalars, nested values).

    A body that is no JSON gives no rows, or with ``report_corrupt`` one row that holds
    its text in ``_corrupt``. A body above ``LARGE_BODY`` that cannot be parsed is an error:
    it may be too large for one value, and :func:`json_records` reads such files.
    """
    parsed = F.try_parse_json(F.col(body))
    large = parsed.isNull() & (F.octet_length(F.col(body)) > LARGE_BODY)
    told = F.raise_error(F.lit("a JSON body is too large to be parsed whole, or no JSON; land it as lines or as an array"))
    node = parsed = F.when(large, told).otherwise(parsed)
    for key in data_path.split(".") if data_path else []:
        node = _step(node, key)
    found = df.select(*keep, node.alias("_node"), F.when(parsed.isNull(), F.col(body)).alias(CORRUPT))
    wanted = F.col("_node").isNotNull()
    if report_corrupt:
        keep = (*keep, CORRUPT)
        wanted = wanted | F.col(CORRUPT).isNotNull()
    items = F.coalesce(F.try_variant_get("_node", "$", "array<variant>"), F.array("_node"))
    rows = found.filter(wanted).select(*keep, F.explode(items).alias("_record"))
    values = {f: _step(F.col("_record"), f) for f in fields}
    out = [(_or_null(v) if typed else F.try_variant_get(v, "$", "string")).alias(f) for f, v in values.items()]
    if value_column:
        out.append(F.try_variant_get("_record", "$", "string").alias(value_column))
    return rows.select(*keep, *out)
