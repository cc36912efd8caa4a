"""Scan, filter and mark queries. Text sources are written from the given tables first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.contracts import SALES, Contract, Field, typed_projection
from tidemark.operators.upsert import insert_if_absent, table_scan_eq, table_stats
from tidemark.session import scratch_path
from tidemark.sources import (
    batch_high_water_mark,
    csv_malformed,
    csv_scan,
    effective_mark,
    incremental_filter,
    json_path_rows,
    late_rows,
    order_by_watermark,
    read_source,
    register_source,
)
from workload import query
from workload.roles import EVENT_SALES_SQL, event_sales, table, when

MARK = datetime(1998, 6, 1)
SINCE = datetime(2000, 1, 1)

ORDER = Contract(
    "order",
    "fact",
    (
        Field("o_orderkey", "key"),
        Field("o_custkey", "key"),
        Field("o_orderstatus", "text"),
        Field("o_totalprice", "number"),
        Field("o_orderdate", "date"),
        Field("o_orderpriority", "text"),
    ),
    unique=("o_orderkey",),
    key=("o_orderkey",),
)


def _landed_csv(spark, df, name, **options):
    path = scratch_path(spark, name)
    df.write.options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss", **options).csv(path)
    return path


@query(
    "csv_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority FROM orders""",
)
def csv(spark, sf_dir):
    path = _landed_csv(spark, table(spark, sf_dir, "orders"), "orders-csv", sep=";")
    return typed_projection(csv_scan(spark, path, delimiter=";"), ORDER)


@query(
    "csv_scan_without_header",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_retailprice FROM part",
)
def csv_without_header(spark, sf_dir):
    contract = Contract(
        "price", "fact", (Field("p_partkey", "key"), Field("p_name", "text"), Field("p_retailprice", "number"))
    )
    path = scratch_path(spark, "parts-csv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(path)
    return typed_projection(read_source(spark, "csv", {"path": path, "has_header": False}, contract), contract)


@query(
    "csv_malformed_gate",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority ||
       CASE WHEN o_totalprice > 400000 THEN ',' || CAST(o_custkey AS VARCHAR) || ',extra' ELSE '' END AS record
FROM orders WHERE o_totalprice > 400000 OR o_totalprice < 50000""",
)
def csv_gate(spark, sf_dir):
    """Lines of two, three or four cells under a header of three; odd ones are kept as text."""
    price, comma = F.col("o_totalprice"), F.lit(",")
    customer = F.col("o_custkey").cast("string")
    tail = (
        F.when(price > 400000, F.concat(comma, customer, F.lit(",extra")))
        .when(price < 50000, F.lit(""))
        .otherwise(F.concat(comma, customer))
    )
    line = F.concat(F.col("o_orderkey").cast("string"), comma, "o_orderpriority", tail)
    path = scratch_path(spark, "ragged")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    raw = csv_scan(spark, path, has_header=False, columns=["order_id", "priority", "customer"])
    return csv_malformed(raw).select("order_id", F.col("_corrupt").alias("record"))


@query(
    "json_path_rows",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def json_path(spark, sf_dir):
    return json_path_rows(table(spark, sf_dir, "events"), "props", "k", value_column="k", keep=["event_id"])


RESPONSES_SQL = """
responses AS (
  SELECT event_id, event_type, user_id, ts FROM events),
records AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at
  FROM responses WHERE event_type IN ('view', 'click')
  UNION ALL
  SELECT event_id, CAST(user_id AS VARCHAR), 'user', NULL FROM responses WHERE event_type = 'view')
"""


def _responses(spark, sf_dir):
    """A response body per event: two records, one record, an empty object or no data."""
    record = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"),
    )
    user = F.struct(F.col("user_id").alias("id"), F.lit("user").alias("kind"), F.lit(None).cast("string").alias("seen_at"))
    many = F.to_json(F.struct(F.struct(F.array(record, user).alias("orders")).alias("data")))
    one = F.to_json(F.struct(F.struct(record.alias("orders")).alias("data")))
    body = F.when(F.col("event_type") == "view", many).when(F.col("event_type") == "click", one)
    body = body.when(F.col("event_type") == "signup", F.lit('{"data": {}}')).otherwise(F.lit('{"other": []}'))
    return table(spark, sf_dir, "events").select("event_id", "ts", body.alias("body"))


@query("json_nested_rows", f"WITH {RESPONSES_SQL} SELECT * FROM records")
def json_nested(spark, sf_dir):
    return json_path_rows(_responses(spark, sf_dir), "body", "data.orders", ["id", "kind", "seen_at"], keep=["event_id"])


@query("json_landed_pages", f"WITH {EVENT_SALES_SQL} SELECT id, region, sale_date FROM sales")
def json_landed(spark, sf_dir):
    """Landed files of up to a thousand records, one to a line, through the source kind."""
    path = scratch_path(spark, "pages")
    record = F.to_json(F.struct("id", "region", "sale_date"))
    event_sales(spark, sf_dir).select(record).write.option("maxRecordsPerFile", 1000).text(path)
    contract = Contract("page", "fact", (Field("id", "key"), Field("region", "text"), Field("sale_date", "date")))
    rows = read_source(spark, "json", {"path": path, "records": "lines"}, contract)
    return typed_projection(rows, contract)


@query(
    "rest_watermark_param",
    f"WITH {RESPONSES_SQL} SELECT event_id, id, seen_at FROM records WHERE seen_at > '2024-01-15 00:00:00'",
)
def rest_mark(spark, sf_dir):
    rows = json_path_rows(_responses(spark, sf_dir), "body", "data.orders", ["id", "seen_at"], keep=["event_id"])
    return incremental_filter(rows, "seen_at", datetime(2024, 1, 15))


@query("incremental_filter", f"SELECT * FROM orders WHERE o_orderdate > {when(MARK)}")
def incremental(spark, sf_dir):
    return incremental_filter(table(spark, sf_dir, "orders"), "o_orderdate", MARK)


@query("since_override", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > {when(SINCE)}")
def since(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return incremental_filter(orders, "o_orderdate", effective_mark(SINCE, MARK))


@query("late_rows", f"SELECT * FROM orders WHERE o_orderdate <= {when(MARK)}")
def late(spark, sf_dir):
    return late_rows(table(spark, sf_dir, "orders"), "o_orderdate", MARK)


@query(
    "batch_high_water_mark",
    f"""SELECT max(l_shipdate) AS high_water_mark FROM lineitem WHERE l_shipdate > {when(MARK)}""",
)
def high_mark(spark, sf_dir):
    batch = incremental_filter(table(spark, sf_dir, "lineitem"), "l_shipdate", MARK)
    return batch_high_water_mark(batch, "l_shipdate")


@query("order_by_watermark", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate")
def ordered(spark, sf_dir):
    return order_by_watermark(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(
    "table_scan_eq",
    "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def scan_eq(spark, sf_dir):
    filters = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    return table_scan_eq(table(spark, sf_dir, "orders"), filters)


@query(
    "table_stats",
    """SELECT 'customer' AS table_name, count(*) AS row_count FROM customer
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem""",
)
def stats(spark, sf_dir):
    return table_stats({n: table(spark, sf_dir, n) for n in ("customer", "part", "lineitem")})


@query(
    "default_current",
    """SELECT CAST(p_partkey AS VARCHAR) AS product_id,
       CASE WHEN p_type = 'PROMO' THEN FALSE ELSE TRUE END AS is_current FROM part""",
)
def default_current(spark, sf_dir):
    contract = Contract(
        "flagged", "dimension", (Field("product_id", "key"), Field("is_current", "flag", default=True))
    )
    flag = F.when(F.col("p_type") == "PROMO", F.lit(False)).when(F.col("p_type") == "LARGE", F.lit(True))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), flag.alias("is_current"))
    return typed_projection(part, contract)


@query(
    "insert_if_absent",
    """WITH target AS (
  SELECT o_custkey, min(o_orderkey) AS o_orderkey, 'target' AS origin FROM orders
  WHERE o_orderstatus = 'F' GROUP BY o_custkey),
batch AS (
  SELECT o_custkey, o_orderkey, 'batch' AS origin,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, origin FROM target
UNION ALL
SELECT o_custkey, o_orderkey, origin FROM batch
WHERE n = 1 AND o_custkey NOT IN (SELECT o_custkey FROM target)""",
)
def absent(spark, sf_dir):
    """First order per customer, into a table of the first fulfilled orders."""
    orders = table(spark, sf_dir, "orders")
    target = (
        orders.filter("o_orderstatus = 'F'")
        .groupBy("o_custkey")
        .agg(F.min("o_orderkey").alias("o_orderkey"))
        .withColumn("origin", F.lit("target"))
    )
    batch = orders.select("o_custkey", "o_orderkey", F.lit("batch").alias("origin"))
    return insert_if_absent(target, batch, ["o_custkey"], [F.col("o_orderkey")])


@register_source("event_log")
def _event_log(spark, options, contract, since):
    """A source kind of its own: the event log in the columns of a contract."""
    return event_sales(spark, options["sf_dir"]).select(*[c for c in contract.columns if c != "updated_at"])


@query("custom_source", f"WITH {EVENT_SALES_SQL} SELECT * FROM sales")
def custom_source(spark, sf_dir):
    raw = read_source(spark, "event_log", {"sf_dir": sf_dir}, SALES)
    return typed_projection(raw, SALES).drop("updated_at")
