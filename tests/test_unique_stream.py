"""Unique keys across micro-batches: restarts, expiry, missing keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.fixtures import day
from tidemark.streaming.unique import first_of_keys

SCHEMA = "k string, j int, at timestamp_ntz, n int"


def taken(spark, tmp_path, rows):
    """Land rows as one file and run the query over what is new."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    kept = first_of_keys(stream, ["k", "j"], F.col("at"), "5 days")
    writer = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted((r.k or "", r.j or 0, r.n) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())


def test_keys_are_unique_across_batches_and_starts(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert taken(spark, tmp_path, [("a", 1, day(1), 1), ("a", 2, day(1), 2), (None, 1, day(1), 3)]) == [("", 1, 3), ("a", 1, 1), ("a", 2, 2)]
        found = taken(spark, tmp_path, [("a", 1, day(3), 4), (None, 1, day(2), 5), ("a", None, day(2), 6), ("b", 1, day(3), 7)])
        assert found == [("", 1, 3), ("a", 0, 6), ("a", 1, 1), ("a", 2, 2), ("b", 1, 7)]
        # Far later the first keys are given up, and what comes behind the watermark or without a time is dropped.
        taken(spark, tmp_path, [("z", 1, day(20), 8)])
        taken(spark, tmp_path, [("z", 2, day(20), 9)])
        found = taken(spark, tmp_path, [("a", 1, day(21), 10), ("a", 1, day(1), 11), ("y", 1, None, 12)])
        assert [r for r in found if r[2] >= 8] == [("a", 1, 10), ("z", 1, 8), ("z", 2, 9)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
