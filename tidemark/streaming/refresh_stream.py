"""The refresh as a stream: new files in, the same checks and loads per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.config import Cube, Source
from tidemark.plans.job import invalidate_loaded, refresh_batch
from tidemark.plans.warehouse import Warehouse
from tidemark.sources.csv import CORRUPT
from tidemark.sources.json import json_path_rows


class FailedBatch(RuntimeError):
    """A micro-batch did not pass its checks. The query stops on it, and its next start
    takes the same files again before any newer one."""


def raw_stream(
    spark: SparkSession, path: str, columns: Sequence[str], files_per_batch: int = 1000, **options: object
) -> DataFrame:
    """CSV files of a folder as a stream of raw string columns, as :func:`csv_scan` gives."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*columns, CORRUPT]])
    raw = (
        spark.readStream.schema(schema)
        .options(header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .options(maxFilesPerTrigger=files_per_batch, enforceSchema=False, columnPruning=False)
        .options(**options)
        .csv(path)
    )
    return raw.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in columns], CORRUPT)


def json_stream(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    data_path: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Landed JSON responses of a folder as a stream of raw string columns."""
    pages = (
        spark.readStream.format("text").options(wholetext=True, maxFilesPerTrigger=files_per_batch).load(path)
    )
    return json_path_rows(pages, "value", data_path, columns, report_corrupt=True)


def refresh_stream(
    warehouse: Warehouse,
    cube: Cube,
    source: Source,
    stream: DataFrame,
    checkpoint: str,
    as_of: datetime | None = None,
    continuous: str | None = None,
) -> StreamingQuery:
    """Refresh a source from a stream: returns when all files are taken, or at once with
    the running query if ``continuous`` gives a trigger interval.

    All micro-batches of a start skip rows by the mark the source had when it began, so what is
    loaded does not depend on how many files one takes; a start that follows an unfinished
    one goes on with its mark. Skipped rows go to the late table.

    The batch id comes from the query, as its checkpoint names it, and the epoch. So a
    micro-batch that is run again after a loss either replaces its own unfinished folder or
    finds itself committed and does nothing, and a query with a new checkpoint starts anew.
    A batch invalidates the cube; :func:`rebuild_stale` rebuilds it once for all of them.
    """

    @cache
    def query_id() -> str:
        return warehouse.spark.read.json(f"{checkpoint}/metadata").first()["id"]

    @cache
    def start_mark() -> datetime | None:
        return warehouse.stream_mark(query_id(), source.name)

    def load(batch: DataFrame, epoch: int) -> None:
        batch_id = f"{source.name}-{query_id()}-{epoch}"
        if warehouse.is_committed(batch_id):
            return
        run = refresh_batch(warehouse, cube.name, source, batch, batch_id, batch_id, start_mark(), as_of, keep_late=True)
        warehouse.log_run(run)
        if run.status == "failed":
            raise FailedBatch("\n".join(run.errors or []))
        invalidate_loaded(warehouse, cube, [run])

    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    query = writer.trigger(**trigger).start()
    if not continuous:
        query.awaitTermination()
        warehouse.finish_stream(query_id())
    return query
