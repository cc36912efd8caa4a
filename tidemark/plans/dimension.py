"""A stored Type 2 dimension: a base of current versions and the changes since.

    dims/<table>/base/<batch id>/                      current versions, rewritten now and then
    dims/<table>/changes/_batch_id=<id>/_op=insert/    versions a batch started
    dims/<table>/changes/_batch_id=<id>/_op=close/     versions a batch ended

A merge writes its changes and nothing else, so its cost follows the batch and not the
dimension. Readers leave out the versions ended since the base. Once those reach a share
of the current versions, a merge also writes a new base, which keeps reads cheap and the
rewriting in proportion to the changes.

Where there is no version yet, each row of a batch starts one: such a batch may be staged where
its versions will stay, with the validity they start with, and is then not written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import Contract
from tidemark.functions.naming import member_of
from tidemark.operators.scd2 import CLOSE, INSERT, VALIDITY, scd2_delta, scd2_first, started_at

# Batch that started a version. With the key it names the version, even where one run
# starts and ends versions of a key at the same moment.
ADDED_BY = "_added_by"

# Ended versions per current version at which the base is written anew.
REBASE_SHARE = 0.2
# Batches since the base at which it is written anew if they started this share of the current
# versions, so that a dimension that only grows does not end in a folder for every batch.
REBASE_BATCHES, GROWN_SHARE = 16, 0.1
# Rows of a batch per current version from which on these are not cut down to its keys first.
WHOLE_SHARE = 0.25


class Merged(NamedTuple):
    inserted: int
    closed: int
    rebased: bool


class DimensionTable:
    """Reads and merges over the commits of one dimension, oldest first."""

    def __init__(self, spark: SparkSession, path: str, contract: Contract, commits: Sequence[Row]) -> None:
        self.spark = spark
        self.path = path
        self.contract = contract
        self.commits = commits
        self.stored = T.StructType([*contract.schema.fields, T.StructField(ADDED_BY, T.StringType())])
        bases = [i for i, c in enumerate(commits) if c["is_base"]]
        self.base = commits[bases[-1]]["batch_id"] if bases else None
        self.since = commits[bases[-1] + 1 :] if bases else commits

    def _load(self, paths: Sequence[str]) -> DataFrame:
        """Named folders, so that their sizes are known when a join is planned."""
        return self.spark.read.schema(self.stored).parquet(*paths)

    def _changes(self, batch_id: str) -> str:
        return f"{self.path}/changes/_batch_id={batch_id}"

    def _open_versions(self, added: Sequence[str], closed: Sequence[str]) -> DataFrame:
        """Versions of the base and of the batches ``added`` that no batch of ``closed`` ended."""
        folders = [f"{self._changes(b)}/_op={INSERT}" for b in added]
        if self.base:
            folders.append(f"{self.path}/base/{self.base}")
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        versions = self._load(folders)
        if not closed:
            return versions
        ended = self._load([f"{self._changes(b)}/_op={CLOSE}" for b in closed])
        return member_of(versions, ended, [*self.contract.key, ADDED_BY], "left_anti", null_safe=False)

    def _batches(self, counted: str) -> list[str]:
        return [c["batch_id"] for c in self.since if c[counted]]

    def stored_current(self) -> DataFrame:
        return self._open_versions(self._batches("rows_inserted"), self._batches("rows_updated"))

    def current(self) -> DataFrame:
        return self.stored_current().drop(ADDED_BY)

    def history(self) -> DataFrame:
        """All versions that were ended."""
        closing = [c["batch_id"] for c in self.commits if c["rows_updated"]]
        if not closing:
            return self.spark.createDataFrame([], self.contract.schema)
        return self._load([f"{self._changes(b)}/_op={CLOSE}" for b in closing]).drop(ADDED_BY)

    def _current_count(self) -> int:
        return sum(c["rows_inserted"] - c["rows_updated"] for c in self.commits)

    def is_empty(self) -> bool:
        """Whether no batch has started a version yet."""
        return not self.base and not self._batches("rows_inserted")

    def starts_in_place(self, order_by: Sequence[str] = ()) -> bool:
        """Whether a batch may be staged as the first versions. The validity its rows came with is
        lost in them, so neither a unique rule nor their order may depend on it."""
        return self.is_empty() and not set(VALIDITY) & {*self.contract.unique_columns, *order_by}

    def first_path(self, batch_id: str) -> str:
        return f"{self._changes(batch_id)}/_op={INSERT}"

    def first_values(self, batch_id: str, as_of: datetime) -> dict[str, Column]:
        """What first versions hold in place of, or beside, the values of their rows."""
        validity = {c: v for c, v in started_at(as_of).items() if c in self.contract.columns}
        return {**validity, ADDED_BY: F.lit(batch_id)}

    def start(self, batch_id: str, rows: int) -> Merged:
        """Take the ``rows`` rows staged at :meth:`first_path` as they are; like those of a merge
        they count once the batch is committed."""
        return Merged(rows, 0, self._rebase(batch_id, rows, 0))

    def merge(self, batch: DataFrame, batch_id: str, as_of: datetime, rows: int = 0) -> Merged:
        """Write the changes a batch of unique keys makes; they count once it is committed.
        ``rows``: how many it has, where that is known."""
        contract = self.contract
        incoming = batch.withColumn(ADDED_BY, F.lit(batch_id))
        stored = self.stored_current()
        if self.is_empty():
            delta = scd2_first(stored, incoming, as_of)
        else:
            cut = rows < WHOLE_SHARE * self._current_count()
            delta = scd2_delta(stored, incoming, contract.key, contract.compare, as_of, unique_keys=True, cut=cut)
        delta.write.mode("overwrite").partitionBy("_op").parquet(self._changes(batch_id))
        written = self.spark.read.schema(f"{contract.key[0]} string, _op string").parquet(self._changes(batch_id))
        counted = {row["_op"]: row["count"] for row in written.groupBy("_op").count().collect()}
        inserted, closed = counted.get(INSERT, 0), counted.get(CLOSE, 0)
        return Merged(inserted, closed, bool(inserted or closed) and self._rebase(batch_id, inserted, closed))

    def _rebase(self, batch_id: str, inserted: int, closed: int) -> bool:
        current = self._current_count()
        ended = closed + sum(c["rows_updated"] for c in self.since)
        started = inserted + sum(c["rows_inserted"] for c in self.since)
        grown = len(self.since) + 1 >= REBASE_BATCHES and started >= GROWN_SHARE * (current + inserted)
        if not grown and (not closed or ended < REBASE_SHARE * current):
            return False
        after = self._open_versions(
            [*self._batches("rows_inserted"), *[batch_id] * bool(inserted)],
            [*self._batches("rows_updated"), *[batch_id] * bool(closed)],
        )
        after.write.mode("overwrite").parquet(f"{self.path}/base/{batch_id}")
        return True
