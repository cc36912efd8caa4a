"""Tables of the warehouse on shared storage, and the commit log that makes them visible.

    facts/<table>/_batch_id=<id>/        rows of a batch, appended
    dims/<table>/                        see :mod:`tidemark.plans.dimension`
    cubes/<cube>/<id>/                   a rebuilt cube
    grains/<cube>/<id>/                  see :mod:`tidemark.plans.grains`
    keys/<table>/_batch_id=<id>/         see :mod:`tidemark.operators.key_index`
    errors/_batch_id=<id>/               issues of a rejected batch
    late/<source>/_batch_id=<id>/          rows a stream skipped for their mark
    state/{commits,folded}/              see :mod:`tidemark.plans.commits`
    state/{runs,invalidations,clears,starts}/

A batch is written under its own id, checked there, and then one commit is added to
the log. Readers look at committed ids only, so that commit makes the data visible and
moves the source's mark in a single step: a batch that fails its checks or a job lost
half way leaves nothing behind that counts, and facts are written just once. Nothing
that is being read is ever overwritten. Several writers may commit: each gets a number of its own,
and one whose batch was made without knowing what another has committed meanwhile to the same
table or from the same source is told so and takes the batch again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import Contract, contract_named
from tidemark.operators.key_index import filter_size, key_filter, may_hold
from tidemark.operators.staging import write_staged
from tidemark.operators.state import INVALIDATIONS, RUNS, Run, invalidations_of, without_cleared
from tidemark.operators.upsert import table_scan_eq
from tidemark.plans.commits import FIELDS, CommitConflict, CommitLog, files_of
from tidemark.plans.dimension import DimensionTable
from tidemark.sources.marks import instant_literal

BATCH = "_batch_id"
CLEARED = "cleared"
COMMITS = (
    "seq bigint, batch_id string, table_name string, source string, watermark timestamp_ntz, "
    "rows_inserted bigint, rows_updated bigint, is_base boolean, "
    "covers bigint, committed_at timestamp_ntz"
)
#: So many commits are handed over as rows, more are read from the log's files.
LISTED = 1000
STARTS = "query_id string, at timestamp_ntz, mark timestamp_ntz, finished boolean"
CLEARS = "cube string, cleared_at timestamp_ntz"
ERRORS = "source string, _row bigint, issue_no int, field string, message string, value string"


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def literal_row(spark: SparkSession, schema: str, values: Sequence[object]) -> DataFrame:
    """A frame of one row, given as literals of the schema's types."""
    columns = []
    for declared, value in zip(schema.split(", "), values, strict=True):
        name, dtype = declared.split(" ")
        if isinstance(value, datetime):
            literal = instant_literal(value)
        elif isinstance(value, list):
            literal = F.array(*[F.lit(v) for v in value])
        else:
            literal = F.lit(value)
        columns.append(literal.cast(dtype).alias(name))
    return spark.range(0, 1, 1, 1).select(*columns)


class Warehouse:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self._log: CommitLog | None = None

    # -- paths and small tables -------------------------------------------------

    def _state(self, name: str) -> str:
        return f"{self.base}/state/{name}"

    def _append(self, name: str, schema: str, values: Sequence[object]) -> None:
        literal_row(self.spark, schema, values).write.mode("append").parquet(self._state(name))

    def _read(self, path: str, schema: T.StructType | str) -> DataFrame:
        """A table that was never written reads as empty."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as error:  # noqa: BLE001 - the class differs between classic and Connect
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    # -- commits ----------------------------------------------------------------

    @property
    def log(self) -> CommitLog:
        if self._log is None:
            files, base = files_of(self.spark, self.base)
            self._log = CommitLog(files, f"{base}/state")
        return self._log

    def commits(self) -> DataFrame:
        rows = self.log.rows()
        if len(rows) <= LISTED:
            return self.spark.createDataFrame(rows, COMMITS)
        return self.spark.read.schema(COMMITS).json(self.log.paths())

    def commits_of(self, table: str) -> list[Row]:
        """Commits of one table since it was last cleared, oldest first: a small row each."""
        rows = [row for row in self.log.rows() if row["table_name"] == table]
        cleared = [i for i, row in enumerate(rows) if row["batch_id"] == CLEARED]
        return rows[cleared[-1] + 1 :] if cleared else rows

    def is_committed(self, batch_id: str) -> bool:
        return any(row["batch_id"] == batch_id for row in self.log.rows())

    def last_commit(self) -> int:
        """Number of the last commit, 0 for none."""
        return len(self.log.rows())

    def commit(
        self,
        batch_id: str,
        table: str,
        source: str | None,
        watermark: datetime | None,
        inserted: int,
        updated: int,
        at: datetime,
        is_base: bool = False,
        covers: int | None = None,
        seen: int | None = None,
        depends: bool = False,
    ) -> None:
        """Make a batch visible. ``covers`` is the last commit of another table it includes.

        ``seen`` is the last commit that the batch was made with. A later one from the same source, or,
        if what the batch holds ``depends`` on the table's rows, to the same table, is a conflict.
        """

        def check(others: Iterable[Row]) -> None:
            for row in others:
                same_source = source is not None and row["source"] == source and batch_id != CLEARED
                if same_source or (depends and row["table_name"] == table):
                    raise CommitConflict(f"commit {row['seq']} of batch {row['batch_id']} came before batch {batch_id}")

        values = (batch_id, table, source, watermark, inserted, updated, is_base, covers, at)
        self.log.append(dict(zip(FIELDS[1:], values)), check if seen is not None else None, seen)

    def watermarks(self) -> DataFrame:
        """Mark and last run time per source, from the commits. A mark never moves back."""
        marked = self.commits().filter(F.col("source").isNotNull() & F.col("watermark").isNotNull())
        return marked.groupBy("source").agg(
            F.max("watermark").alias("last_watermark"), F.max("committed_at").alias("last_run_time")
        )

    def watermark(self, source: str) -> datetime | None:
        own = (row["watermark"] for row in self.log.rows() if row["source"] == source and row["watermark"])
        return max(own, default=None)

    # -- facts ------------------------------------------------------------------

    def _fact_path(self, table: str) -> str:
        return f"{self.base}/facts/{table}"

    def facts(self, schema: str, filters: dict | None = None) -> DataFrame:
        """Rows of committed batches, read from their folders only."""
        contract = contract_named(schema)
        ids = [row["batch_id"] for row in self.commits_of(contract.table)]
        return table_scan_eq(self.fact_batches(contract, ids), filters)

    def fact_batches(self, contract: Contract, ids: Sequence[str]) -> DataFrame:
        """Named folders: what was rejected, lost or cleared is not even listed."""
        if not ids:
            return self.spark.createDataFrame([], contract.schema)
        paths = [self.fact_batch_path(contract, i) for i in dict.fromkeys(ids)]
        return self.spark.read.schema(contract.schema).parquet(*paths)

    def facts_holding(self, contract: Contract, asked: DataFrame) -> DataFrame:
        """Facts of the committed batches that may hold one of the keys asked for, by the filter of each
        batch's keys. Batches that came without one get it here, from their key columns."""
        loads = {r["batch_id"]: r["rows_inserted"] for r in self.commits_of(contract.table) if r["rows_inserted"]}
        path, table = f"{self.base}/keys/{contract.table}", f"keys_{contract.table}"
        indexed = {r["batch_id"] for r in self.commits_of(table)}
        for batch_id in loads.keys() - indexed:
            made = key_filter(self.fact_batch(contract, batch_id), contract.key, filter_size(loads[batch_id]))
            made.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
            self.commit(batch_id, table, None, None, 0, 0, utc_now())
        if not loads:
            return self.fact_batches(contract, [])
        schema = f"size bigint, word bigint, bits bigint, {BATCH} string"
        paths = [f"{path}/{BATCH}={batch_id}" for batch_id in loads]
        filters = self.spark.read.schema(schema).option("basePath", path).parquet(*paths)
        sizes = sorted({filter_size(rows) for rows in loads.values()})
        found = may_hold(filters, asked, contract.key, sizes, BATCH).collect()
        return self.fact_batches(contract, [row[BATCH] for row in found])

    def write_batch(self, path: str, df: DataFrame, batch_id: str, sort: str | None = None) -> None:
        """Write the folder of one batch. A retry replaces its own folder and no other."""
        if sort:
            df = df.sortWithinPartitions(sort)
        df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    def fact_batch_path(self, contract: Contract, batch_id: str) -> str:
        return f"{self._fact_path(contract.table)}/{BATCH}={batch_id}"

    def fact_batch(self, contract: Contract, batch_id: str) -> DataFrame:
        """Rows of one batch, committed or not."""
        return self.spark.read.schema(contract.schema).parquet(self.fact_batch_path(contract, batch_id))

    def append_facts(self, contract: Contract, df: DataFrame, batch_id: str, sort: str | None) -> None:
        self.write_batch(self._fact_path(contract.table), df, batch_id, sort)

    # -- dimensions -------------------------------------------------------------

    def dimension_table(self, schema: str) -> DimensionTable:
        contract = contract_named(schema)
        path = f"{self.base}/dims/{contract.table}"
        return DimensionTable(self.spark, path, contract, self.commits_of(contract.table))

    def current(self, schema: str) -> DataFrame:
        """Current versions only; no history is read."""
        return self.dimension_table(schema).current()

    def history(self, schema: str) -> DataFrame:
        """Versions that were closed."""
        return self.dimension_table(schema).history()

    def dimension(self, schema: str, filters: dict | None = None) -> DataFrame:
        """All versions, closed and current."""
        table = self.dimension_table(schema)
        return table_scan_eq(table.history().unionByName(table.current()), filters)

    # -- runs, errors, invalidations ---------------------------------------------

    def _append_rows(self, name: str, schema: str, rows: DataFrame) -> None:
        """Append a frame in the columns of a state table; columns it lacks are NULL."""
        given = set(rows.columns)
        declared = [c.split(" ") for c in schema.split(", ")]
        typed = [(F.col(n) if n in given else F.lit(None)).cast(t).alias(n) for n, t in declared]
        rows.select(*typed).write.mode("append").parquet(self._state(name))

    def log_run(self, run: Run) -> None:
        self._append("runs", RUNS, run)

    def log_runs(self, runs: DataFrame) -> None:
        """Append run records that another system kept."""
        self._append_rows("runs", RUNS, runs)

    def runs(self) -> DataFrame:
        return self._read(self._state("runs"), RUNS)

    def write_errors(self, errors: DataFrame, batch_id: str) -> None:
        self.write_batch(f"{self.base}/errors", errors, batch_id)

    def errors(self) -> DataFrame:
        return self._read(f"{self.base}/errors", f"{ERRORS}, {BATCH} string")

    def write_late(self, rows: DataFrame, source: str, batch_id: str) -> int:
        """Keep rows a batch skipped for their mark; returns how many they are."""
        path = f"{self.base}/late/{source}"
        self.write_batch(path, rows, batch_id)
        return self.spark.read.schema(rows.schema).parquet(f"{path}/{BATCH}={batch_id}").count()

    def late(self, source: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.base}/late/{source}")

    # -- stream starts -----------------------------------------------------------

    def stream_mark(self, query: str, source: str) -> datetime | None:
        """Mark that a start of a stream holds to: that of the last start if it did not come to
        its end, else the source's mark now."""
        starts = self._read(self._state("starts"), STARTS).filter(F.col("query_id") == query)
        last = starts.orderBy(F.desc("at")).first()
        if last and not last["finished"]:
            return last["mark"]
        mark = self.watermark(source)
        self._append("starts", STARTS, (query, utc_now(), mark, False))
        return mark

    def finish_stream(self, query: str) -> None:
        self._append("starts", STARTS, (query, utc_now(), None, True))

    def invalidate(self, cube: str, sources: Sequence[str], at: datetime, reason: str) -> None:
        self._append("invalidations", INVALIDATIONS, (cube, list(sources), at, reason))

    def invalidate_all(self, events: DataFrame) -> None:
        """Append a frame of invalidation events."""
        self._append_rows("invalidations", INVALIDATIONS, events)

    def clear_all(self, clears: DataFrame) -> None:
        """Append a frame of clears: ``cube``, ``cleared_at``."""
        self._append_rows("clears", CLEARS, clears)

    def invalidations(self, cube: str | None = None) -> DataFrame:
        events = self._read(self._state("invalidations"), INVALIDATIONS)
        return invalidations_of(without_cleared(events, self._read(self._state("clears"), CLEARS)), cube)

    def invalidation_stream(self) -> DataFrame:
        """Invalidations as they come, for a listener's ``foreachBatch``."""
        return self.spark.readStream.schema(INVALIDATIONS).parquet(self._state("invalidations"))

    def clear_invalidations(self, at: datetime, cube: str | None = None) -> None:
        """Hide the events so far, of one cube or of all."""
        open_cubes = self.invalidations(cube).select("cube").distinct()
        marks = open_cubes.withColumn("cleared_at", instant_literal(at))
        write_staged(marks, name="clears").coalesce(1).write.mode("append").parquet(self._state("clears"))

    # -- cubes ------------------------------------------------------------------

    def write_cube(self, name: str, cube: DataFrame, batch_id: str, at: datetime, covers: int | None = None) -> None:
        """``covers``: the last commit of its inputs that the cube includes."""
        cube.write.mode("overwrite").parquet(f"{self.base}/cubes/{name}/{batch_id}")
        self.commit(batch_id, f"cube_{name}", None, None, 0, 0, at, covers=covers)

    def last_change(self, tables: Sequence[str]) -> int:
        """Number of the last commit that changed one of the tables, 0 for none."""
        own = (row for row in self.log.rows() if row["table_name"] in tables)
        return max((r["seq"] for r in own if r["rows_inserted"] or r["rows_updated"] or r["batch_id"] == CLEARED), default=0)

    def cube(self, name: str) -> DataFrame | None:
        commits = self.commits_of(f"cube_{name}")
        if not commits:
            return None
        return self.spark.read.parquet(f"{self.base}/cubes/{name}/{commits[-1]['batch_id']}")

    def is_stale(self, name: str, tables: Sequence[str] = ()) -> bool:
        """Whether the cube was invalidated after it was last built, or some input table
        changed since, whoever changed it; a cube never built is stale once there is either."""
        built = self.commits_of(f"cube_{name}")
        events = self.invalidations(name)
        if built:
            events = events.filter(F.col("event_time") > instant_literal(built[-1]["committed_at"]))
        covered = (built[-1]["covers"] or 0) if built else 0
        return self.last_change(tables) > covered or not events.isEmpty()

    # -- statistics -------------------------------------------------------------

    def stats(self) -> DataFrame:
        """Rows per stored table, from the commits: no table is scanned. Every version of a
        dimension was inserted once, so inserts count its rows as well."""
        loaded = self.commits().filter(~F.col("table_name").rlike("^(cube|grain|keys)_"))
        cleared = F.max(F.when(F.col("batch_id") == CLEARED, F.col("seq"))).over(Window.partitionBy("table_name"))
        kept = loaded.withColumn("_cleared", cleared).filter("_cleared IS NULL OR seq > _cleared")
        return kept.groupBy("table_name").agg(F.sum("rows_inserted").alias("row_count"))

    def clear(self, schema: str, at: datetime) -> None:
        """Empty a table for its readers; marks stay, and files go when they are cleaned up."""
        self.commit(CLEARED, contract_named(schema).table, None, None, 0, 0, at)
