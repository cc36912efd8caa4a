"""Type 2 versions that arrive late: a start inside history cuts the version that covers it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.naming import member_of
from tidemark.operators.staging import first_per_key

CHANGED, KEPT = "add", "same"
ENDS = ("valid_to", "is_current")


def _by_start(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.col("valid_from").asc_nulls_first(), "_late")


def _timeline(dimension: DataFrame, incoming: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Stored and incoming versions of the incoming keys by start. ``_covering``: the end of the stored version that
    covers the start, or came last before it; a stored version whose place an incoming one takes is left out."""
    types = dict(dimension.dtypes)
    late = first_per_key(incoming, [*keys, "valid_from"], [F.xxhash64(*compare)])
    late = late.select(*[(F.col(c) if c in late.columns and c not in ENDS else F.lit(None)).cast(types[c]).alias(c) for c in dimension.columns])
    stored = member_of(dimension, late, keys, "left_semi").withColumn("_late", F.lit(False))
    both = stored.unionByName(late.withColumn("_late", F.lit(True)))
    up_to_here = _by_start(keys).rowsBetween(Window.unboundedPreceding, 0)
    ended = F.last(F.when(~F.col("_late"), F.struct("valid_to")), ignorenulls=True).over(up_to_here)
    replaced = ~F.col("_late") & F.coalesce(F.lead("valid_from").over(_by_start(keys)) == F.col("valid_from"), F.lit(False))
    replacing = F.col("_late") & F.coalesce(F.lag("valid_from").over(_by_start(keys)) == F.col("valid_from"), F.lit(False))
    marked = both.select("*", ended.alias("_covering"), replaced.alias("_replaced"), replacing.alias("_replacing"))
    return marked.filter(~F.col("_replaced")).drop("_replaced")


def backdated_versions(dimension: DataFrame, incoming: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """All versions of the incoming keys after the batch, with ``_op``: ``add`` for those that are new or end at
    another time than before, ``same`` for the others.

    Each incoming row starts a version at its own ``valid_from``. It cuts the stored version that covers this
    moment and takes over its end, or the start of the next one if that comes earlier; a row at the very
    start of a stored version takes its place, one before all of them ends where the first begins. Several
    rows of a key cut one after another. A row that says the same as the version before it, while that
    still holds, changes nothing. Of rows with equal key and start one counts, always the same.
    """
    timeline = _timeline(dimension, incoming, keys, compare)
    values = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(compare)])
    covered = F.col("_covering").isNotNull() & (
        F.col("_covering.valid_to").isNull() | (F.col("_covering.valid_to") > F.col("valid_from"))
    )
    same = F.lag(values).over(_by_start(keys)).eqNullSafe(values)
    idle = F.col("_late") & covered & ~F.col("_replacing") & same
    left = timeline.select("*", covered.alias("_covered"), idle.alias("_idle")).filter(~F.col("_idle"))
    following = F.lead("valid_from").over(_by_start(keys))
    held = F.when(~F.col("_late") | F.col("_covered"), F.col("_covering.valid_to"))
    done = left.withColumn("_end", F.least(held, following))  # of two missing ones the version is open
    op = F.when(F.col("_late") | ~F.col("_end").eqNullSafe(F.col("valid_to")), F.lit(CHANGED)).otherwise(F.lit(KEPT))
    given = {"valid_to": F.col("_end"), "is_current": F.col("_end").isNull()}
    return done.select(*[given.get(c, F.col(c)).alias(c) for c in dimension.columns], op.alias("_op"))


def scd2_backdated(dimension: DataFrame, incoming: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """The whole dimension after the batch; keys that the batch lacks stay as they are, and are not sorted."""
    others = member_of(dimension, incoming, keys, "left_anti")
    return others.unionByName(backdated_versions(dimension, incoming, keys, compare).drop("_op"))
