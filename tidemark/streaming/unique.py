"""Unique keys across the micro-batches of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKEYED = "_unkeyed"


def first_of_keys(rows: DataFrame, keys: Sequence[str], at: Column, within: str) -> DataFrame:
    """The first row of every key, whichever micro-batch or start of the query it came with.

    Seen keys are kept as state, dealt out by key and stored with the query's checkpoint, and given up
    once the watermark, the latest time ``at`` seen less ``within``, has passed their row by ``within``: so a
    repeated row is found if it is no more than that apart, and the state does not grow with the
    stream. Rows behind the watermark come too late to be checked and are dropped; rows without a time have no
    place in it and are dropped as well. A missing key is a key of its own.
    """
    names = list(rows.columns)
    missing = F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(str(i))) for i, k in enumerate(keys)])
    timed = rows.withColumn("_at", at.cast("timestamp")).filter(F.col("_at").isNotNull()).withColumn(UNKEYED, missing)
    first = timed.withWatermark("_at", within).dropDuplicatesWithinWatermark([*keys, UNKEYED])
    return first.select(*names)
