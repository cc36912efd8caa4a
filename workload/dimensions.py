"""Type 2 dimension queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.contracts import Contract, Field, register_contract, typed_projection
from tidemark.operators import scd2
from tidemark.plans.warehouse import Warehouse
from tidemark.session import scratch_path
from workload import query
from workload.roles import CHANGED, DIMENSION_SQL, OPENED, customer_batch, customer_dimension, table

KEY, COMPARE = ["customer_id"], ["segment", "balance"]

ACCOUNT_HOLDER = register_contract(
    Contract(
        "account_holder",
        "dimension",
        (
            Field("customer_id", "key"),
            Field("customer_name", "text"),
            Field("balance", "number"),
            Field("segment", "text"),
            Field("valid_from", "date"),
            Field("valid_to", "date", optional=True),
            Field("is_current", "flag", default=True),
        ),
        key=("customer_id",),
        compare=("segment", "balance"),
    )
)


def _sides(spark, sf_dir):
    return customer_dimension(spark, sf_dir), customer_batch(spark, sf_dir)


@query("scd2_current", f"WITH {DIMENSION_SQL} SELECT * FROM existing WHERE is_current")
def current(spark, sf_dir):
    return scd2.scd2_current(customer_dimension(spark, sf_dir))


@query("scd2_change_detect", f"WITH {DIMENSION_SQL} SELECT customer_id, change FROM compared")
def change_detect(spark, sf_dir):
    dimension, batch = _sides(spark, sf_dir)
    return scd2.scd2_change_detect(scd2.scd2_current(dimension), batch, KEY, COMPARE)


@query("scd2_inserts", f"WITH {DIMENSION_SQL} SELECT * FROM inserts")
def inserts(spark, sf_dir):
    dimension, batch = _sides(spark, sf_dir)
    return scd2.scd2_inserts(scd2.scd2_current(dimension), batch, KEY, COMPARE, CHANGED)


@query("scd2_closes", f"WITH {DIMENSION_SQL} SELECT * FROM closes")
def closes(spark, sf_dir):
    dimension, batch = _sides(spark, sf_dir)
    return scd2.scd2_closes(scd2.scd2_current(dimension), batch, KEY, COMPARE, CHANGED)


@query("scd2_merge", f"WITH {DIMENSION_SQL} SELECT * FROM merged")
def merge(spark, sf_dir):
    dimension, batch = _sides(spark, sf_dir)
    return scd2.scd2_merge(dimension, batch, KEY, COMPARE, CHANGED, unique_keys=True)


@query(
    "scd2_as_of",
    f"""WITH {DIMENSION_SQL}
SELECT * FROM merged
WHERE valid_from <= TIMESTAMP '2024-03-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-03-01')""",
)
def as_of(spark, sf_dir):
    dimension, batch = _sides(spark, sf_dir)
    merged = scd2.scd2_merge(dimension, batch, KEY, COMPARE, CHANGED, unique_keys=True)
    return scd2.scd2_as_of(merged, datetime(2024, 3, 1))


LINE_SQL = """
old AS (
  SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL),
new AS (
  SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity FROM lineitem GROUP BY ALL)
"""


@query(
    "scd2_composite_key",
    f"""WITH {LINE_SQL},
change AS (
  SELECT n.*, o.quantity AS was, o.l_orderkey IS NULL AS is_new
  FROM new n LEFT JOIN old o USING (l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, CAST(quantity AS DOUBLE) AS quantity, TIMESTAMP '2002-01-01' AS valid_from,
       CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current
FROM change WHERE is_new OR was <> quantity
UNION ALL
SELECT l_orderkey, l_linenumber, CAST(was AS DOUBLE), TIMESTAMP '1999-01-01', TIMESTAMP '2002-01-01', FALSE
FROM change WHERE was <> quantity
UNION ALL
SELECT l_orderkey, l_linenumber, CAST(was AS DOUBLE), TIMESTAMP '1999-01-01', NULL, TRUE
FROM change WHERE was = quantity""",
)
def composite_key(spark, sf_dir):
    """Quantities per order line, as known in 1999 and as known later."""
    lineitem = table(spark, sf_dir, "lineitem")

    def totals(lines):
        quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
        return lines.groupBy("l_orderkey", "l_linenumber").agg(quantity.alias("quantity"))

    first = F.lit("1999-01-01").cast("timestamp_ntz")
    old = totals(lineitem.filter(F.col("l_shipdate") < first)).select(
        "*", first.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current")
    )
    return scd2.scd2_merge(
        old, totals(lineitem), ["l_orderkey", "l_linenumber"], ["quantity"], datetime(2002, 1, 1), unique_keys=True
    )


@query(
    "scd2_as_of_join",
    """WITH starts AS (
  SELECT o_custkey AS custkey, o_orderdate AS valid_from, max(o_orderpriority) AS tier FROM orders GROUP BY ALL),
versions AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY custkey ORDER BY valid_from) AS valid_to FROM starts),
lines AS (
  SELECT o_custkey, l_shipdate, l_quantity, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, tier, count(*) AS line_count,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lines LEFT JOIN versions ON o_custkey = custkey AND valid_from <= l_shipdate
  AND (valid_to IS NULL OR l_shipdate < valid_to)
GROUP BY l_returnflag, tier""",
)
def as_of_join(spark, sf_dir):
    """Lines by the priority tier their customer had when they were shipped. Every order
    date starts a new version of the customer's tier."""
    orders = table(spark, sf_dir, "orders")
    following = Window.partitionBy("custkey").orderBy("valid_from")
    versions = (
        orders.groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("valid_from"))
        .agg(F.max("o_orderpriority").alias("tier"))
        .withColumn("valid_to", F.lead("valid_from").over(following))
        .withColumnRenamed("custkey", "o_custkey")
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "l_shipdate", "l_quantity", "l_returnflag")
    )
    joined = scd2.as_of_join(lines, versions, "o_custkey", "l_shipdate", ["tier"], slot="year")
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return joined.groupBy("l_returnflag", "tier").agg(
        F.count(F.lit(1)).alias("line_count"), quantity.alias("quantity")
    )


def _stored_dimension(spark, sf_dir) -> Warehouse:
    """The customer dimension loaded into a warehouse, then the later batch merged in."""
    warehouse = Warehouse(spark, scratch_path(spark, "dimension"))
    dimension, batch = _sides(spark, sf_dir)
    contract, name = ACCOUNT_HOLDER, ACCOUNT_HOLDER.name
    first = scd2.scd2_current(dimension).drop("valid_to", "is_current")
    later = batch.withColumn("valid_from", F.lit(CHANGED.isoformat(sep=" ")).cast("timestamp_ntz"))
    for batch_id, rows, moment in (("first", first, OPENED), ("later", later, CHANGED)):
        typed = typed_projection(rows, contract)
        done = warehouse.dimension_table(name).merge(typed, batch_id, moment)
        warehouse.commit(
            batch_id, contract.table, name, moment, done.inserted, done.closed, moment, is_base=done.rebased
        )
    return warehouse


@query("dim_append", f"WITH {DIMENSION_SQL} SELECT * FROM inserts")
def dim_append(spark, sf_dir):
    stored = _stored_dimension(spark, sf_dir).current(ACCOUNT_HOLDER.name)
    return stored.filter(F.col("valid_from") == F.lit(CHANGED.isoformat(sep=" ")).cast("timestamp_ntz"))


@query("dim_close", f"WITH {DIMENSION_SQL} SELECT * FROM closes")
def dim_close(spark, sf_dir):
    return _stored_dimension(spark, sf_dir).history(ACCOUNT_HOLDER.name)


@query(
    "dim_versions",
    f"""WITH {DIMENSION_SQL}
SELECT * FROM merged WHERE valid_from >= {"TIMESTAMP '2024-01-01'"}""",
)
def dim_versions(spark, sf_dir):
    return _stored_dimension(spark, sf_dir).dimension(ACCOUNT_HOLDER.name)
