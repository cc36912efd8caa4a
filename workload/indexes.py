"""Reads that an index cuts down: keys against stored batches, marks against files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import SALES
from tidemark.operators.upsert import absent_rows
from tidemark.plans import Warehouse
from tidemark.session import scratch_path
from tidemark.sources.manifest import FileMarks
from workload import query
from workload.extract import MARK
from workload.roles import table, when

#: Orders as sales; a fifth of a year's orders come a second time with the next year's batch.
SALES_SQL = """sales AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS region, CAST(o_orderdate AS TIMESTAMP) AS sale_date,
         year(o_orderdate) AS y FROM orders)"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    columns = {
        "id": F.col("o_orderkey").cast("string"), "product_id": F.lit("P"), "customer_id": F.col("o_custkey").cast("string"),
        "quantity": F.lit(1.0), "amount": F.col("o_totalprice").cast("double"), "sale_date": F.col("o_orderdate").cast("timestamp_ntz"),
        "region": F.col("o_orderstatus"), "updated_at": F.lit(None).cast("timestamp_ntz"),
    }
    return orders.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in SALES.schema.fields])


def stored_years(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, DataFrame]:
    """All orders but those of the last year, a batch for each year."""
    warehouse, sales = Warehouse(spark, scratch_path(spark, "warehouse")), _sales(spark, sf_dir)
    years = [r[0] for r in sales.select(F.year("sale_date").alias("y")).distinct().orderBy("y").collect()]
    for y in years[:-1]:
        own = sales.filter(F.year("sale_date") == y)
        warehouse.append_facts(SALES, own, f"y{y}", None)
        warehouse.commit(f"y{y}", SALES.table, "orders", datetime(y, 12, 31), own.count(), 0, datetime(y, 12, 31))
    return warehouse, sales


LAST_SQL = f"""WITH {SALES_SQL},
years AS (SELECT DISTINCT y FROM sales), last AS (SELECT max(y) AS y FROM years),
batch AS (
  SELECT id, region, sale_date FROM sales WHERE y = (SELECT y FROM last)
  UNION ALL SELECT id, 'again', sale_date FROM sales WHERE y = (SELECT y FROM last) - 1 AND CAST(id AS BIGINT) % 5 = 0)"""


def last_batch(sales: DataFrame) -> DataFrame:
    """Orders of the last year, and a fifth of the year before once more."""
    last = sales.agg(F.max(F.year("sale_date"))).first()[0]
    year = F.year("sale_date")
    again = sales.filter((year == last - 1) & (F.col("id").cast("bigint") % 5 == 0)).withColumn("region", F.lit("again"))
    return sales.filter(year == last).unionByName(again)


@query("insert_if_absent_indexed", f"{LAST_SQL} SELECT id, region FROM batch WHERE region <> 'again'")
def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last batch whose keys no stored batch has; only batches that may have one are read."""
    warehouse, sales = stored_years(spark, sf_dir)
    batch = last_batch(sales)
    stored = warehouse.facts_holding(SALES, batch.select("id"))
    return absent_rows(stored, batch, ["id"], [F.col("sale_date")]).select("id", "region")


@query("unique_against_stored", f"{LAST_SQL} SELECT id, sale_date FROM batch WHERE region = 'again'")
def against_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the last batch that are stored already, with the stored date."""
    warehouse, sales = stored_years(spark, sf_dir)
    asked = last_batch(sales).select(F.col("id").alias("asked")).distinct()
    stored = warehouse.facts_holding(SALES, asked.withColumnRenamed("asked", "id"))
    return stored.join(asked, F.col("id") == F.col("asked"), "left_semi").select("id", "sale_date")


def ranged_orders(spark: SparkSession, sf_dir: str) -> FileMarks:
    """Orders as a table of files by date, and their manifest."""
    folder = scratch_path(spark, "ranged")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    orders.repartitionByRange(16, "o_orderdate").write.parquet(f"{folder}/orders")
    return FileMarks(spark, f"{folder}/orders", f"{folder}/marks", "o_orderdate")


@query("incremental_files", f"SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders WHERE o_orderdate > {when(MARK)}")
def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged_orders(spark, sf_dir).past(MARK)


@query("late_files", f"SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders WHERE o_orderdate <= {when(MARK)}")
def late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged_orders(spark, sf_dir).late(MARK)


@query("mark_of_files", "SELECT CAST(max(o_orderdate) AS TIMESTAMP) AS high_water_mark FROM orders")
def mark_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranged_orders(spark, sf_dir).high_water_mark()
