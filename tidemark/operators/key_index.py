"""Which stored batches may hold a key: a Bloom filter per batch, as a table of 64-bit words.

A filter of some ten bits a key is built by partial aggregates and probed by a join on its words, so it is
never held whole by the driver or a task, and a small batch of keys can be broadcast against it.
It names no batch wrongly as free of a key; about one in a hundred is named without need for each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES, LEAST_BITS = 10, 7, 1024


def filter_size(rows: int) -> int:
    """Bits of a filter over so many keys, a power of two."""
    return max(LEAST_BITS, 1 << (BITS_PER_KEY * rows - 1).bit_length())


def _places(keys: Sequence[str], size: Column) -> Column:
    """The key's places in a filter of this size, each with its number."""
    return F.array(
        *[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(F.lit(i), *keys), size).alias("place")) for i in range(HASHES)]
    )


def _word(name: str) -> Column:
    return F.expr("shiftright(p.place, 6)").alias(name)


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(p.place & 63 as int))").alias("bit")


def key_filter(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``size``, ``word`` and ``bits`` of the filter over the keys of some rows."""
    placed = rows.select(F.explode(_places(keys, F.lit(size))).alias("p"))
    words = placed.select(_word("word"), _bit()).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return words.select(F.lit(size).cast("bigint").alias("size"), "word", "bits")


def may_hold(filters: DataFrame, asked: DataFrame, keys: Sequence[str], sizes: Sequence[int], by: str) -> DataFrame:
    """The filters (told apart by the column ``by``) that may hold at least one of the keys asked for. ``sizes``: all that occur."""
    if not sizes:
        return filters.select(by).limit(0)
    every = F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])).alias("size")
    sized = asked.select(*keys).distinct().select(F.xxhash64(*keys).alias("key"), *keys, every)
    placed = sized.select("key", "size", F.explode(_places(keys, F.col("size"))).alias("p"))
    probes = placed.select("key", F.col("size").alias("_size"), _word("_word"), _bit(), F.col("p.i").alias("i"))
    met = filters.join(probes, (F.col("size") == F.col("_size")) & (F.col("word") == F.col("_word")))
    set_ = met.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    found = set_.groupBy(by, "key").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("all"))
    return found.filter(F.col("all") == (1 << HASHES) - 1).select(by).distinct()
