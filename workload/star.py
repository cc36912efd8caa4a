"""Star join and cube queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators.cubes import DimensionJoin, build_cube, star_join
from tidemark.operators.scd2 import scd2_merge
from workload import query
from workload.roles import CHANGED, DIMENSION_SQL, customer_batch, customer_dimension, table, when

MEASURES = ["l_quantity", "l_extendedprice"]
BY = ["c_mktsegment", "p_brand", "o_orderstatus"]


def _facts(spark, sf_dir):
    columns = ["l_orderkey", "l_partkey", *MEASURES]
    return table(spark, sf_dir, "lineitem").select(*columns)


def _dimensions(spark, sf_dir):
    return [
        DimensionJoin(table(spark, sf_dir, "part"), "l_partkey", "p_partkey", ("p_brand",)),
        DimensionJoin(table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", ("o_custkey", "o_orderstatus")),
        DimensionJoin(table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ("c_mktsegment",)),
    ]


STAR_SQL = """
star AS (
  SELECT c_mktsegment, p_brand, o_orderstatus, CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey)
"""
SUMS_SQL = """CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, CAST(sum(l_extendedprice) AS DOUBLE) AS l_extendedprice,
       count(*) AS row_count"""


def _plain(cube):
    """Sums as doubles and the grouping id as an integer, for comparison."""
    return cube.withColumns(
        {**{m: F.col(m).cast("double") for m in MEASURES}, "grouping_id": F.col("grouping_id").cast("bigint")}
    )


@query(
    "star_join",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""",
)
def star(spark, sf_dir):
    """Orders with their customer; overdrawn customers are not in the dimension."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return star_join(orders, [DimensionJoin(customers, "o_custkey", "c_custkey", ("c_name", "c_mktsegment"))])


MOVED = datetime(2024, 1, 15)


@query(
    "star_join_as_of",
    f"""WITH {DIMENSION_SQL.replace(when(CHANGED), when(MOVED))}
SELECT event_id, event_type, segment
FROM events LEFT JOIN merged ON CAST(user_id AS VARCHAR) = customer_id AND valid_from <= ts
  AND (valid_to IS NULL OR ts < valid_to)""",
)
def star_as_of(spark, sf_dir):
    """Events with the segment their customer was in at the time."""
    versions = scd2_merge(
        customer_dimension(spark, sf_dir),
        customer_batch(spark, sf_dir),
        ["customer_id"],
        ["segment", "balance"],
        MOVED,
        unique_keys=True,
    )
    events = table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    joined = star_join(events, [DimensionJoin(versions, "user", "customer_id", ("segment",), at="ts")])
    return joined.select("event_id", "event_type", "segment")


@query(
    "cube_rebuild",
    f"""WITH {STAR_SQL}
SELECT c_mktsegment, p_brand, o_orderstatus,
       CAST(grouping_id(c_mktsegment, p_brand, o_orderstatus) AS BIGINT) AS grouping_id, {SUMS_SQL}
FROM star GROUP BY CUBE (c_mktsegment, p_brand, o_orderstatus)""",
)
def cube(spark, sf_dir):
    return _plain(build_cube(_facts(spark, sf_dir), _dimensions(spark, sf_dir), BY, MEASURES))


@query(
    "cube_rollup",
    f"""WITH {STAR_SQL}
SELECT c_mktsegment, p_brand, o_orderstatus,
       CAST(grouping_id(c_mktsegment, p_brand, o_orderstatus) AS BIGINT) AS grouping_id, {SUMS_SQL}
FROM star GROUP BY ROLLUP (c_mktsegment, p_brand, o_orderstatus)""",
)
def rollup(spark, sf_dir):
    return _plain(build_cube(_facts(spark, sf_dir), _dimensions(spark, sf_dir), BY, MEASURES, mode="rollup"))


@query(
    "cube_grouping_sets",
    f"""WITH {STAR_SQL}
SELECT c_mktsegment, p_brand, o_orderstatus,
       CAST(grouping_id(c_mktsegment, p_brand, o_orderstatus) AS BIGINT) AS grouping_id, {SUMS_SQL}
FROM star GROUP BY GROUPING SETS ((c_mktsegment, o_orderstatus), (p_brand), ())""",
)
def grouping_sets(spark, sf_dir):
    sets = [["c_mktsegment", "o_orderstatus"], ["p_brand"], []]
    built = build_cube(
        _facts(spark, sf_dir), _dimensions(spark, sf_dir), BY, MEASURES, mode="sets", sets=sets, collapse_first=False
    )
    return _plain(built)


@query(
    "cube_collapsed_facts",
    """WITH star AS (
  SELECT p_brand, l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT p_brand, l_returnflag, CAST(grouping_id(p_brand, l_returnflag) AS BIGINT) AS grouping_id,
       CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, CAST(sum(l_extendedprice) AS DOUBLE) AS l_extendedprice,
       count(*) AS row_count
FROM star GROUP BY CUBE (p_brand, l_returnflag)""",
)
def collapsed(spark, sf_dir):
    """Lines are summed per part before the join, since many share one."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", *MEASURES)
    parts = DimensionJoin(table(spark, sf_dir, "part"), "l_partkey", "p_partkey", ("p_brand",))
    return _plain(build_cube(lines, [parts], ["p_brand", "l_returnflag"], MEASURES, collapse_first=True))
