"""Delimited text as raw string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def csv_scan(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    has_header: bool = True,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """All columns as strings plus ``_corrupt``, the text of a record with a wrong cell count.

    Types come from the contract later, so no pass over the data infers them. The scan
    stays splittable unless ``multi_line`` is asked for. An empty cell is an empty
    string: only a column the file lacks counts as missing.
    """
    options = {
        "sep": delimiter,
        "escape": '"',
        "header": has_header,
        "multiLine": multi_line,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        # A pruned parser does not count cells, so it would let ragged records pass.
        "columnPruning": False,
    }
    if has_header:
        names = spark.read.options(**options).csv(path).columns
    elif columns:
        names = list(columns)
    else:
        raise ValueError("a file without a header needs column names")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = spark.read.schema(schema).options(**options, enforceSchema=False).csv(path)
    return raw.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names], CORRUPT)


def csv_malformed(raw: DataFrame) -> DataFrame:
    """Records that make the whole batch unusable; an empty result opens the gate."""
    return raw.filter(F.col(CORRUPT).isNotNull())
