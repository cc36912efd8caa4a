"""Star joins and cube aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.naming import all_of
from tidemark.operators.scd2 import as_of_join

# Amounts, their sums per dimension key, and sums of those.
MONEY, SUMMED, TOTAL = "decimal(18,2)", "decimal(28,2)", "decimal(38,2)"


@dataclass(frozen=True)
class DimensionJoin:
    """How a fact reaches a dimension: its frame, the key on both sides, the attributes
    wanted. The frame has at most one row per key, the current version.

    With ``at``, a time column of the fact, the frame holds all versions, and a fact gets
    the one valid at that time.
    """

    frame: DataFrame
    fact_key: str | tuple[str, ...]
    dimension_key: str | tuple[str, ...]
    attributes: tuple[str, ...]
    at: str | None = None

    def __post_init__(self) -> None:
        if len(self.fact_keys) != len(self.dimension_keys):
            raise ValueError(f"keys {self.fact_key} and {self.dimension_key} differ in length")

    @property
    def fact_keys(self) -> tuple[str, ...]:
        return (self.fact_key,) if isinstance(self.fact_key, str) else tuple(self.fact_key)

    @property
    def dimension_keys(self) -> tuple[str, ...]:
        return (self.dimension_key,) if isinstance(self.dimension_key, str) else tuple(self.dimension_key)


def star_join(fact: DataFrame, dimensions: Sequence[DimensionJoin]) -> DataFrame:
    """Fact rows with the attributes of each dimension; an unknown member gives NULLs.

    No join strategy is forced: a dimension below the broadcast threshold is broadcast,
    and beyond it AQE splits a fact partition that one member fills.
    """
    joined = fact
    for number, dim in enumerate(dimensions):
        if dim.at:
            joined = as_of_join(
                joined, dim.frame, dim.fact_keys, dim.at, dim.attributes, dimension_key=dim.dimension_keys
            )
            continue
        clash = sorted(set(dim.attributes) & set(joined.columns))
        if clash:
            raise ValueError(f"the facts already have columns {clash}")
        keys = [f"_d{number}_{k}" for k in range(len(dim.fact_keys))]
        side = dim.frame.select(*[F.col(c).alias(k) for c, k in zip(dim.dimension_keys, keys)], *dim.attributes)
        on_key = all_of([F.col(c) == F.col(k) for c, k in zip(dim.fact_keys, keys)])
        joined = joined.join(side, on_key, "left").drop(*keys)
    return joined


def collapse_facts(
    fact: DataFrame, dimensions: Sequence[DimensionJoin], by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Sums and row counts per dimension key and per attribute the fact itself has.

    Such sums of batches add up, and the dimensions are joined to them like to facts.
    """
    sums = [F.sum(F.col(m).cast(MONEY)).alias(m) for m in measures]
    return fact.groupBy(*fact_groups(fact, dimensions, by)).agg(*sums, F.count(F.lit(1)).alias("row_count"))


def uncollapsed_facts(
    fact: DataFrame, dimensions: Sequence[DimensionJoin], by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Each fact as a sum of one row, to be added to those of :func:`collapse_facts`."""
    amounts = [F.col(m).cast(MONEY).alias(m) for m in measures]
    return fact.select(*fact_groups(fact, dimensions, by), *amounts, F.lit(1).cast("bigint").alias("row_count"))


def fact_groups(fact: DataFrame, dimensions: Sequence[DimensionJoin], by: Sequence[str]) -> list[str]:
    """The dimension keys and the attributes the fact itself has."""
    keys = [k for d in dimensions for k in (*d.fact_keys, d.at) if k]
    return list(dict.fromkeys([*keys, *[c for c in by if c in fact.columns]]))


def finest_grain(
    fact: DataFrame,
    dimensions: Sequence[DimensionJoin],
    by: Sequence[str],
    measures: Sequence[str],
    collapse_first: bool = False,
) -> DataFrame:
    """Sums and row counts per combination of all ``by`` columns.

    ``collapse_first`` sums the facts per dimension key before the joins. It pays when
    many facts share their keys and the dimensions are too big to broadcast.
    """
    if collapse_first:
        return grain_of_collapsed(collapse_facts(fact, dimensions, by, measures), dimensions, by, measures)
    sums = [F.sum(F.col(m).cast(MONEY)).alias(m) for m in measures]
    return star_join(fact, dimensions).groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("row_count"))


def grain_of_collapsed(
    collapsed: DataFrame, dimensions: Sequence[DimensionJoin], by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """``collapsed`` may hold facts that were not summed yet; the types are the same either way."""
    sums = [F.sum(m).cast(TOTAL).alias(m) for m in measures]
    return star_join(collapsed, dimensions).groupBy(*by).agg(*sums, F.sum("row_count").alias("row_count"))


def build_cube(
    fact: DataFrame,
    dimensions: Sequence[DimensionJoin],
    by: Sequence[str],
    measures: Sequence[str],
    mode: str = "cube",
    sets: Sequence[Sequence[str]] = (),
    collapse_first: bool = False,
) -> DataFrame:
    """Measures summed over a cube, a rollup or given grouping sets of ``by``.

    The facts are summed once at the finest grain, and the supersets are taken from that
    small table: expanding the facts themselves would send each of them through the
    aggregate once per grouping set. ``grouping_id`` tells a subtotal from a NULL member.
    """
    return cube_of_grain(finest_grain(fact, dimensions, by, measures, collapse_first), by, measures, mode, sets)


def cube_of_grain(
    grain: DataFrame,
    by: Sequence[str],
    measures: Sequence[str],
    mode: str = "cube",
    sets: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Supersets of sums at the finest grain."""
    if mode == "cube":
        grouped = grain.cube(*by)
    elif mode == "rollup":
        grouped = grain.rollup(*by)
    elif mode == "sets":
        grouped = grain.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    else:
        raise ValueError(f"unknown cube mode {mode!r}")
    totals = [F.sum(m).alias(m) for m in measures]
    return grouped.agg(F.grouping_id().alias("grouping_id"), *totals, F.sum("row_count").alias("row_count"))
