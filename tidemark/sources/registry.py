"""Source kinds by name. A reader gives the raw columns of a source; the mark it is told
about may spare it work, the rows are filtered by it afterwards in any case."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.contracts import Contract
from tidemark.sources.csv import csv_scan
from tidemark.sources.jdbc import jdbc_scan
from tidemark.sources.json import json_pages, json_path_rows, json_records
from tidemark.sources.rest import rest_pages

Since = tuple[str, datetime] | None
Reader = Callable[[SparkSession, dict, Contract, Since], DataFrame]
READERS: dict[str, Reader] = {}


def register_source(kind: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        READERS[kind] = reader
        return reader

    return add


def read_source(
    spark: SparkSession, kind: str, options: dict, contract: Contract, since: Since = None
) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for sources of kind {kind!r}")
    return READERS[kind](spark, options, contract, since)


@register_source("csv")
def _csv(spark: SparkSession, options: dict, contract: Contract, since: Since) -> DataFrame:
    return csv_scan(spark, **{"columns": contract.columns, **options})


@register_source("jdbc")
def _jdbc(spark: SparkSession, options: dict, contract: Contract, since: Since) -> DataFrame:
    return jdbc_scan(spark, **options)


@register_source("json")
def _json(spark: SparkSession, options: dict, contract: Contract, since: Since) -> DataFrame:
    """Landed responses, or with ``records`` landed records: ``lines`` or one ``array`` a file."""
    if options.get("records"):
        return json_records(spark, options["path"], contract.columns, options["records"] == "lines")
    pages = json_pages(spark, options["path"])
    return json_path_rows(pages, "body", options.get("data_path"), contract.columns, report_corrupt=True, typed=True)


@register_source("rest")
def _rest(spark: SparkSession, options: dict, contract: Contract, since: Since) -> DataFrame:
    """Responses fetched now."""
    request = {k: v for k, v in options.items() if k != "data_path"}
    pages = rest_pages(spark, since=since, **request)
    return json_path_rows(pages, "body", options.get("data_path"), contract.columns, report_corrupt=True, typed=True)


@register_source("parquet")
def _parquet(spark: SparkSession, options: dict, contract: Contract, since: Since) -> DataFrame:
    return spark.read.parquet(options["path"])
