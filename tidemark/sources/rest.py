"""Service responses as rows: each URL is fetched by a task of its own.

A Python data source, so that fetching is spread over the executors and retried like any
task. The package has to be on their path (``--py-files``).
"""

from __future__ import annotations

import json
from base64 import b64encode
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone
from urllib.parse import urlencode, urlsplit, urlunsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "rest_pages"


def request_headers(headers: Mapping[str, str] | None = None, auth: Mapping[str, str] | None = None) -> dict[str, str]:
    """JSON by default, then the given headers, then a bearer or basic authorization."""
    merged = {"Content-Type": "application/json", **(headers or {})}
    auth = auth or {}
    if auth.get("type") == "bearer" and auth.get("token"):
        merged["Authorization"] = f"Bearer {auth['token']}"
    elif auth.get("type") == "basic" and auth.get("username") and auth.get("password"):
        pair = f"{auth['username']}:{auth['password']}".encode()
        merged["Authorization"] = f"Basic {b64encode(pair).decode()}"
    return merged


def url_since(url: str, column: str, mark: datetime) -> str:
    """The URL with the mark as a query parameter named like its column, in UTC."""
    if mark.tzinfo is not None:
        mark = mark.astimezone(timezone.utc).replace(tzinfo=None)
    text = mark.isoformat(timespec="milliseconds") + "Z"
    parts = urlsplit(url)
    query = "&".join(p for p in (parts.query, urlencode({column: text})) if p)
    return urlunsplit(parts._replace(query=query))


class _Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.urls = json.loads(options["urls"])
        self.headers = json.loads(options.get("headers", "{}"))
        self.method = options.get("method", "GET")
        self.timeout = float(options.get("timeout", "60"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Page(url) for url in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        request = Request(partition.url, headers=self.headers, method=self.method)
        with urlopen(request, timeout=self.timeout) as response:
            yield partition.url, response.read().decode("utf-8")


class RestPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def rest_pages(
    spark: SparkSession,
    urls: Sequence[str],
    method: str = "GET",
    headers: Mapping[str, str] | None = None,
    auth: Mapping[str, str] | None = None,
    since: tuple[str, datetime] | None = None,
    timeout: float = 60.0,
) -> DataFrame:
    """One row per URL: ``url`` and the response ``body``. A response that is not a success
    fails its task, and with it the source."""
    spark.dataSource.register(RestPages)
    if since:
        urls = [url_since(url, *since) for url in urls]
    options = {
        "urls": json.dumps(list(urls)),
        "method": method,
        "headers": json.dumps(request_headers(headers, auth)),
        "timeout": str(timeout),
    }
    return spark.read.format(FORMAT).options(**options).load()
