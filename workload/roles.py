"""The given tables in the roles the operators expect, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its time columns are wall-clock times whatever the file calls them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def when(moment: datetime) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


# -- orders as a raw text batch of sales, with faults on values ----------------------

FEED_SQL = """
feed0 AS (
  SELECT o_orderkey * 2 AS _row,
         CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice > 480000 THEN ''
              ELSE o_orderpriority END AS product_id,
         CASE WHEN o_totalprice >= 1500 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
         CASE WHEN o_totalprice > 495000 THEN '-3' WHEN o_totalprice < 2000 THEN 'many' ELSE '1' END AS quantity,
         CASE WHEN o_totalprice < 5000 THEN 'n/a'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
         CASE WHEN o_orderdate >= TIMESTAMP '2001-07-25' THEN 'unknown'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS sale_date,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 490000 THEN '' ELSE o_orderstatus END AS region,
         o_orderstatus = 'F' AND o_totalprice > 450000 AS sent_again
  FROM orders),
feed AS (
  SELECT _row, id, product_id, customer_id, quantity, amount, sale_date, region FROM feed0
  UNION ALL
  SELECT _row + 1, id, product_id, customer_id, quantity, amount, sale_date, region FROM feed0 WHERE sent_again)
"""


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    priority = F.col("o_orderpriority")
    feed = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * 2).alias("_row"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.when((priority == "4-NOT SPECIFIED") & (price > 480000), "").otherwise(priority).alias("product_id"),
        F.when(price >= 1500, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(price > 495000, "-3").when(price < 2000, "many").otherwise("1").alias("quantity"),
        F.when(price < 5000, "n/a").otherwise(price.cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(F.col("o_orderdate") >= F.lit("2001-07-25").cast("timestamp_ntz"), "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("sale_date"),
        F.when((status == "P") & (price > 490000), "").otherwise(status).alias("region"),
        ((status == "F") & (price > 450000)).alias("sent_again"),
    )
    again = feed.filter("sent_again").withColumn("_row", F.col("_row") + 1)
    return feed.unionByName(again).drop("sent_again")


FEED_ERRORS_SQL = (
    FEED_SQL
    + """,
errors AS (
  SELECT _row, 2 AS issue_no, 'customer_id' AS field, 'Invalid input' AS message, customer_id AS value
  FROM feed WHERE customer_id IS NULL
  UNION ALL
  SELECT _row, 3, 'quantity', 'Expected number, received string', quantity
  FROM feed WHERE TRY_CAST(quantity AS DOUBLE) IS NULL
  UNION ALL
  SELECT _row, 3, 'quantity', 'Number must be greater than 0', quantity
  FROM feed WHERE TRY_CAST(quantity AS DOUBLE) <= 0
  UNION ALL
  SELECT _row, 4, 'amount', 'Expected number, received string', amount
  FROM feed WHERE TRY_CAST(amount AS DOUBLE) IS NULL
  UNION ALL
  SELECT _row, 5, 'sale_date', 'Invalid date', sale_date
  FROM feed WHERE TRY_CAST(sale_date AS TIMESTAMP) IS NULL
  UNION ALL
  SELECT _row, 6, 'region', 'String must contain at least 1 character(s)', region FROM feed WHERE region = ''
  UNION ALL
  SELECT _row, 9, 'product_id', 'Required field is missing or empty', product_id FROM feed WHERE product_id = ''
  UNION ALL
  SELECT _row, 10, 'customer_id', 'Required field is missing or empty', customer_id
  FROM feed WHERE customer_id IS NULL
  UNION ALL
  SELECT _row, 13, 'id', 'Duplicate value found', id
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _row) AS n FROM feed) WHERE n > 1)
"""
)

# -- customers as a dimension and as the batch that follows it ------------------------

OPENED = datetime(2024, 1, 1)
CHANGED = datetime(2024, 6, 1)

DIMENSION_SQL = f"""
existing AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_acctbal AS balance,
         c_mktsegment AS segment, {when(OPENED)} AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
         TRUE AS is_current
  FROM customer WHERE c_mktsegment <> 'MACHINERY'
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), c_name, c_acctbal, 'TRIAL', TIMESTAMP '2023-01-01', {when(OPENED)}, FALSE
  FROM customer WHERE c_acctbal < 0),
incoming AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_acctbal AS balance,
         CASE WHEN c_acctbal > 9000 THEN 'PREMIUM' ELSE c_mktsegment END AS segment
  FROM customer),
compared AS (
  SELECT i.*, e.customer_id AS old_id, e.segment AS old_segment, e.balance AS old_balance,
         e.customer_name AS old_name, e.valid_from AS old_from,
         CASE WHEN e.customer_id IS NULL THEN 'new'
              WHEN e.segment IS DISTINCT FROM i.segment OR e.balance IS DISTINCT FROM i.balance THEN 'changed'
              ELSE 'same' END AS change
  FROM incoming i LEFT JOIN existing e ON i.customer_id = e.customer_id AND e.is_current),
inserts AS (
  SELECT customer_id, customer_name, balance, segment, {when(CHANGED)} AS valid_from,
         CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current
  FROM compared WHERE change <> 'same'),
closes AS (
  SELECT customer_id, old_name AS customer_name, old_balance AS balance, old_segment AS segment,
         old_from AS valid_from, {when(CHANGED)} AS valid_to, FALSE AS is_current
  FROM compared WHERE change = 'changed'),
merged AS (
  SELECT e.* FROM existing e WHERE NOT e.is_current
  UNION ALL
  SELECT e.* FROM existing e JOIN compared c ON e.customer_id = c.customer_id
  WHERE e.is_current AND c.change = 'same'
  UNION ALL SELECT * FROM inserts
  UNION ALL SELECT * FROM closes)
"""


def _moment(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def customer_columns(df: DataFrame, segment: F.Column) -> list[F.Column]:
    return [
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_acctbal").alias("balance"),
        segment.alias("segment"),
    ]


def customer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    opened = OPENED.isoformat(sep=" ")
    current = customer.filter("c_mktsegment <> 'MACHINERY'").select(
        *customer_columns(customer, F.col("c_mktsegment")),
        _moment(opened).alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    trial = customer.filter("c_acctbal < 0").select(
        *customer_columns(customer, F.lit("TRIAL")),
        _moment("2023-01-01").alias("valid_from"),
        _moment(opened).alias("valid_to"),
        F.lit(False).alias("is_current"),
    )
    return current.unionByName(trial)


def customer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_acctbal") > 9000, "PREMIUM").otherwise(F.col("c_mktsegment"))
    return customer.select(*customer_columns(customer, segment))


# -- events as sales, as refresh runs and as invalidations ----------------------------

EVENT_SALES_SQL = """
sales AS (
  SELECT CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS product_id,
         CAST(user_id AS VARCHAR) AS customer_id,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity,
         greatest(value, CAST(0.01 AS DOUBLE)) AS amount,
         ts AS sale_date, event_type AS region
  FROM events)
"""


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales in text form, as a file or a service would deliver them; a cent at the least."""
    product = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        product.alias("product_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        (product.cast("int") + 1).cast("string").alias("quantity"),
        F.greatest("value", F.lit(0.01)).cast("string").alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sale_date"),
        F.col("event_type").alias("region"),
    )


EVENT_RUNS_SQL = """
runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS cube, CAST(user_id AS VARCHAR) AS source,
         ts AS start_time, ts + to_milliseconds(CAST(round(value * 100) AS BIGINT)) AS end_time,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS rows_processed,
         CASE WHEN value < 5 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS rows_inserted,
         CAST(length(event_type) AS BIGINT) AS rows_updated,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status
  FROM events)
"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    processed = F.get_json_object("props", "$.k").cast("bigint")
    took = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("event_type").alias("cube"),
        F.col("user_id").cast("string").alias("source"),
        F.col("ts").alias("start_time"),
        F.timestamp_add("MICROSECOND", took * 1000, F.col("ts").cast("timestamp"))
        .cast("timestamp_ntz")
        .alias("end_time"),
        processed.alias("rows_processed"),
        F.when(F.col("value") < 5, F.lit(0)).otherwise(processed).alias("rows_inserted"),
        F.length("event_type").cast("bigint").alias("rows_updated"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )
