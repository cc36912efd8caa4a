"""Keys that repeat across the micro-batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.streaming.unique import first_of_keys
from workload import query
from workload.roles import table


def landed_days(spark: SparkSession, sf_dir: str, folder: str, first: bool) -> None:
    """Events of the first half of the month, or of the second half, as files."""
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    events.filter(F.col("ts") <= middle if first else F.col("ts") > middle).write.mode("append").parquet(folder)


@query("unique_in_stream", "SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL")
def unique_in_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' kinds of events, each once, from a stream that is stopped after half of it and started again."""
    landed, checkpoint, out = (scratch_path(spark, name) for name in ("landed", "stream", "first"))
    for first in (True, False):
        landed_days(spark, sf_dir, landed, first)
        rows = spark.readStream.schema("user_id bigint, event_type string, ts timestamp_ntz").parquet(landed)
        kept = first_of_keys(rows, ["user_id", "event_type"], F.col("ts"), "60 days")
        writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")
