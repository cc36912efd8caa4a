from tidemark.sources.csv import csv_malformed, csv_scan
from tidemark.sources.jdbc import jdbc_scan
from tidemark.sources.json import json_pages, json_path_rows
from tidemark.sources.marks import (
    batch_high_water_mark,
    effective_mark,
    incremental_filter,
    late_rows,
    order_by_watermark,
)
from tidemark.sources.registry import read_source, register_source
from tidemark.sources.rest import rest_pages

__all__ = [
    "batch_high_water_mark",
    "csv_malformed",
    "csv_scan",
    "effective_mark",
    "incremental_filter",
    "jdbc_scan",
    "json_pages",
    "json_path_rows",
    "late_rows",
    "order_by_watermark",
    "read_source",
    "register_source",
    "rest_pages",
]
