"""Connected components by alternating stars, as joins and aggregates of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties every neighbour of a node that is larger (or not larger) to the smallest one around."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(back) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    joined = around.join(least, "a")
    if large:
        tied = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        tied = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return tied.filter("a > b").distinct()


def roots(edges: DataFrame, folder: str) -> DataFrame:
    """``a``, ``b``: each node of ``edges`` (long columns a, b) but the smallest of its component, and that smallest one.

    Direction, loops and repeated edges do not matter. Rounds grow with the logarithm of the
    nodes; each is written below ``folder`` and read from there by the next.
    """
    now = staged(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0"
    )
    print_ = None
    for k in range(1, 1 << 16):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == print_:
            return now
        print_ = mark
        now = staged(_stars(staged(_stars(now, True), f"{folder}/{k}-large"), False), f"{folder}/{k}")
    raise RuntimeError("components do not settle")
