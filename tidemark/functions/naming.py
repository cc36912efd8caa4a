"""Small column helpers shared by the joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in (columns or df.columns)])


def matches(keys: Sequence[str], prefix: str, null_safe: bool = True) -> Column:
    """Key columns equal their prefixed copies. Null-safe equality still hashes as an
    equi-join; plain equality can also reuse a partitioning by the keys."""
    pairs = [(F.col(k), F.col(prefix + k)) for k in keys]
    return all_of([a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def member_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = True
) -> DataFrame:
    """Semi or anti join of ``left`` against the keys of ``right``."""
    return left.join(prefixed(right, "_m_", keys), matches(keys, "_m_", null_safe), how)
