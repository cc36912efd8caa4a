"""Staged batches: written once as Parquet, so that every later pass reads the same rows.

A row's place in its files survives retries, lost executors and different splits, which
a number handed out by a running job does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.naming import matches, member_of
from tidemark.session import scratch_path

POSITION = "_pos"
ROW = "_row"

# A position is the task, the chunk of its output and the row's index there, in this many bits.
_ROW_BITS, _CHUNK_BITS = 32, 12


def write_staged(df: DataFrame, path: str | None = None, name: str = "batch") -> DataFrame:
    """Write the frame to the shared folder and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_number(name: Column) -> Column:
    """Number of a file as Spark names it: ``part-<task>-<uuid>-c<chunk>.<codec>.parquet``.

    More chunks of one task than the bits hold would collide, so they are an error.
    """
    task = F.substring_index(F.substring_index(name, "-", 2), "-", -1).cast("long")
    last = F.substring_index(F.substring_index(name, "-", -1), ".", 1)
    chunk = F.substring(last, F.lit(2), F.length(last)).cast("long")
    most = 1 << _CHUNK_BITS
    checked = F.when(chunk < most, chunk).otherwise(F.raise_error(F.lit(f"a task wrote over {most} files of a batch")))
    return F.shiftleft(task, _CHUNK_BITS) + checked.cast("long")


def with_position(staged: DataFrame) -> DataFrame:
    """Adds ``_pos``: unique and in batch order, but not without gaps.

    Batch order is that of the rows within a source file. Spark deals out the files of a
    batch by size, so between files there is none unless the batch was sorted when staged.
    """
    number = _file_number(F.col("_metadata.file_name"))
    position = F.shiftleft(number, _ROW_BITS) + F.col("_metadata.row_index")
    return staged.select("*", position.alias(POSITION))


def batch_row_ordinal(positioned: DataFrame) -> DataFrame:
    """Adds ``_row``: 0, 1, 2, … in batch order, to all rows of the files they are read from.

    The rows of each file are counted and the counts summed up file by file; only that
    table, one row per file, meets in a single task and is sent to all. No row of the batch
    moves: by their file they would come together in as few tasks as there are files.
    """
    located = positioned.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    per_file = located.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_file_number(F.col("_file"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(
        F.col("_file").alias("_o_file"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    joined = located.join(F.broadcast(offsets), F.col("_file") == F.col("_o_file"), "left")
    return joined.withColumn(ROW, F.col("_offset") + F.col("_index")).drop("_file", "_index", "_o_file", "_offset")


def ordered_batch(df: DataFrame, order: Sequence[str], name: str = "batch") -> DataFrame:
    """Stage a frame in the order of some columns: range shuffle, then sort per partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return with_position(write_staged(ranged, name=name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key. Each task cuts its own rows to one per key before the
    shuffle, so a key that holds most of the rows costs no more than any other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


# From this many rows on, a key is handled apart. Only the largest keys need it: those behind this
# many larger ones hold less than a thousandth of the rows each.
HOT_ROWS, MOST_HOT = 1_000_000, 1000


def hot_keys(counted: DataFrame, keys: Sequence[str], count_column: str, hot_rows: int) -> DataFrame | None:
    """The largest keys with at least ``hot_rows`` rows, ``MOST_HOT`` at most; None when there are
    none, as in most batches. ``counted`` has one row per key; the few hot ones are written out, so
    that no later plan counts again."""
    most = counted.agg(F.max(count_column).alias("n")).first()["n"] or 0
    if most < hot_rows:
        return None
    largest = counted.filter(F.col(count_column) >= hot_rows).orderBy(F.desc(count_column)).limit(MOST_HOT)
    return write_staged(largest.select(*keys), name="hot")


def join_hot_apart(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "inner"
) -> DataFrame:
    """Join many rows per key with at most one lookup row per key (null keys match).

    The hot keys and their lookup rows, ``MOST_HOT`` at most, go to every task: rows of a hot key
    meet them where they lie and are never brought together. Only the other rows are joined by key.
    """
    extra = [c for c in lookup.columns if c not in keys]
    wanted = [*rows.columns, *extra]

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias("_l_" + k) for k in keys], *extra)

    on_key = matches(keys, "_l_")
    if hot is None:
        return rows.join(named(lookup), on_key, how).select(*wanted)
    hot = F.broadcast(hot)
    hot_lookup = write_staged(named(member_of(lookup, hot, keys, "left_semi")), name="hot")
    apart = member_of(rows, hot, keys, "left_semi").join(F.broadcast(hot_lookup), on_key, how)
    others = member_of(rows, hot, keys, "left_anti").join(named(lookup), on_key, how)
    return apart.select(*wanted).unionByName(others.select(*wanted))
