"""Whole refresh jobs over files and tables written from the given ones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.contracts import SALES, Contract, Field, register_contract, typed_projection
from tidemark.operators.staging import write_staged
from tidemark.plans import Cube, Job, Source, Warehouse, rebuild_stale, refresh
from tidemark.plans.job import refresh_batch
from tidemark.session import scratch_path
from tidemark.streaming import raw_stream, refresh_stream
from workload import query
from workload.roles import EVENT_SALES_SQL, event_sales, table

FIRST, SECOND = datetime(2024, 2, 1), datetime(2024, 3, 1)
MIDDLE = "2024-01-15 00:00:00"

VERSIONED = (Field("valid_from", "date"), Field("valid_to", "date", optional=True), Field("is_current", "flag", default=True))

CUBE = Cube(
    "sales", ("sales", "products", "customers"), dimensions=("product", "customer"), measures=("quantity", "amount")
)
REGION_CUBE = Cube("regions", ("sales",), measures=("amount",))


def _products(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.lit("2024-01-01").alias("valid_from"),
    )


def _customers(spark, sf_dir, later=False):
    segment = F.col("c_mktsegment")
    if later:
        segment = F.when(F.col("c_acctbal") > 9000, "PREMIUM").otherwise(segment)
    mail = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        mail.alias("email"),
        segment.alias("segment"),
        F.lit("2024-01-20" if later else "2024-01-01").alias("valid_from"),
    )


def _landed(spark, df):
    path = scratch_path(spark, "landed")
    df.write.options(header=True, escape='"').csv(path)
    return path


def _job(sales, products, customers, cubes=(CUBE,)):
    return Job(
        (
            Source("sales", "csv", "sales", {"path": sales}, "sale_date"),
            Source("products", "csv", "product", {"path": products}, "valid_from"),
            Source("customers", "csv", "customer", {"path": customers}, "valid_from"),
        ),
        cubes,
    )


def _two_refreshes(spark, sf_dir, cubes=(CUBE,)):
    """A first load of the sales up to the middle of the month, then a refresh over all of
    them with some customers in another segment. Returns the warehouse and both run logs."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    sales = event_sales(spark, sf_dir)
    early = _landed(spark, sales.filter(F.col("sale_date") <= MIDDLE))
    products = _landed(spark, _products(spark, sf_dir))
    first = refresh(
        warehouse, _job(early, products, _landed(spark, _customers(spark, sf_dir)), cubes), as_of=FIRST, run_id="first"
    )
    later = _landed(spark, _customers(spark, sf_dir, later=True))
    second = refresh(warehouse, _job(_landed(spark, sales), products, later, cubes), as_of=SECOND, run_id="second")
    return warehouse, first.unionByName(second)


@query(
    "refresh",
    f"""WITH {EVENT_SALES_SQL}
SELECT 'first' AS run_id, 'sales' AS source, 'success' AS status, count(*) AS rows_processed,
       count(*) AS rows_inserted, CAST(0 AS BIGINT) AS rows_updated, max(sale_date) AS watermark
FROM sales WHERE sale_date <= TIMESTAMP '{MIDDLE}'
UNION ALL
SELECT 'second', 'sales', 'success', count(*), count(*), 0, max(sale_date) FROM sales
WHERE sale_date > TIMESTAMP '{MIDDLE}'
UNION ALL
SELECT 'first', 'products', 'success', count(*), count(*), 0, TIMESTAMP '2024-01-01' FROM part
UNION ALL
SELECT 'second', 'products', 'success', 0, 0, 0, NULL
UNION ALL
SELECT 'first', 'customers', 'success', count(*), count(*), 0, TIMESTAMP '2024-01-01' FROM customer
UNION ALL
SELECT 'second', 'customers', 'success', count(*), count(*) FILTER (c_acctbal > 9000),
       count(*) FILTER (c_acctbal > 9000), TIMESTAMP '2024-01-20' FROM customer""",
)
def refresh_runs(spark, sf_dir):
    _, runs = _two_refreshes(spark, sf_dir)
    return runs.select("run_id", "source", "status", "rows_processed", "rows_inserted", "rows_updated", "watermark")


def _cubes_sql(segment: str) -> str:
    return f"""WITH {EVENT_SALES_SQL},
star AS (
  SELECT region, p_type AS category, {segment} AS segment,
         CAST(quantity AS DECIMAL(18,2)) AS quantity, CAST(amount AS DECIMAL(18,2)) AS amount
  FROM sales LEFT JOIN part ON product_id = CAST(p_partkey AS VARCHAR)
  LEFT JOIN customer ON customer_id = CAST(c_custkey AS VARCHAR))
SELECT 'sales' AS cube, region, category, segment,
       CAST(grouping_id(region, category, segment) AS BIGINT) AS grouping_id,
       CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS row_count
FROM star GROUP BY CUBE (region, category, segment)
UNION ALL
SELECT 'regions', region, NULL, NULL, CAST(grouping_id(region) AS BIGINT), NULL, CAST(sum(amount) AS DOUBLE), count(*)
FROM star GROUP BY CUBE (region)"""


def _both_cubes(warehouse):
    plain = []
    for cube in (CUBE, REGION_CUBE):
        built = warehouse.cube(cube.name)
        sums = {m: F.col(m).cast("double") for m in cube.measures}
        plain.append(
            built.withColumns({**sums, "grouping_id": F.col("grouping_id").cast("bigint"), "cube": F.lit(cube.name)})
        )
    return plain[0].unionByName(plain[1], allowMissingColumns=True)


@query("refresh_all_cubes", _cubes_sql("CASE WHEN c_acctbal > 9000 THEN 'PREMIUM' ELSE c_mktsegment END"))
def all_cubes(spark, sf_dir):
    warehouse, _ = _two_refreshes(spark, sf_dir, cubes=(CUBE, REGION_CUBE))
    return _both_cubes(warehouse)


@query("refresh_cube_by_cube", _cubes_sql("c_mktsegment"))
def cube_by_cube(spark, sf_dir):
    """Two calls, one for each of two cubes over the same sales: the second one loads no row
    and still builds its cube from what the first one loaded."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    files = [_landed(spark, f(spark, sf_dir)) for f in (event_sales, _products, _customers)]
    job = _job(*files, cubes=(CUBE, REGION_CUBE))
    for cube in job.cubes:
        refresh(warehouse, job, cube.name, as_of=FIRST)
    return _both_cubes(warehouse)


@query("fact_append", f"WITH {EVENT_SALES_SQL} SELECT * FROM sales")
def fact_append(spark, sf_dir):
    """Two batches, the second one written twice as after a lost job: no row repeats."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    typed = typed_projection(event_sales(spark, sf_dir), SALES)
    early = F.col("sale_date") <= F.lit(MIDDLE).cast("timestamp_ntz")
    for batch_id, rows in (("early", typed.filter(early)), ("late", typed.filter(~early)), ("late", typed.filter(~early))):
        warehouse.append_facts(SALES, rows, batch_id, "sale_date")
    for batch_id in ("early", "late"):
        warehouse.commit(batch_id, SALES.table, "sales", FIRST, 0, 0, FIRST)
    return warehouse.facts("sales").drop("updated_at")


@query("refresh_batch", f"WITH {EVENT_SALES_SQL} SELECT * FROM sales WHERE sale_date > TIMESTAMP '{MIDDLE}'")
def one_batch(spark, sf_dir):
    """One batch straight from a table, past an explicit mark; the stored facts are read back."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    source = Source("sales", "table", "sales", {}, "sale_date")
    mark = datetime.fromisoformat(MIDDLE)
    refresh_batch(warehouse, "sales", source, event_sales(spark, sf_dir), "run", "batch", mark=mark, as_of=FIRST)
    return warehouse.facts("sales").drop("updated_at")


@query("refresh_stream", f"WITH {EVENT_SALES_SQL} SELECT * FROM sales")
def stream(spark, sf_dir):
    """Sales files taken as a stream; a second run finds no new file and adds nothing."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    sales = event_sales(spark, sf_dir)
    source = Source("sales", "csv", "sales", {}, "sale_date")
    landed, checkpoint = _landed(spark, sales), scratch_path(spark, "stream")
    for _ in range(2):
        files = raw_stream(spark, landed, sales.columns)
        refresh_stream(warehouse, REGION_CUBE, source, files, checkpoint, as_of=FIRST)
    return warehouse.facts("sales").drop("updated_at")


@query("refresh_stream_chunks", f"WITH {EVENT_SALES_SQL} SELECT * FROM sales")
def stream_chunks(spark, sf_dir):
    """Files that go back in time, one to a micro-batch: no row is taken for late."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    sales = event_sales(spark, sf_dir)
    source = Source("sales", "csv", "sales", {}, "sale_date")
    landed, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "stream")
    edges = ["2024-01-21", MIDDLE, "2024-01-08", ""]
    for start, end in zip(edges, ["9999", *edges]):
        part = sales.filter((F.col("sale_date") > start) & (F.col("sale_date") <= end))
        part.write.options(header=True, escape='"').mode("append").csv(landed)
    files = raw_stream(spark, landed, sales.columns, files_per_batch=1)
    refresh_stream(warehouse, REGION_CUBE, source, files, checkpoint, as_of=FIRST)
    return warehouse.facts("sales").drop("updated_at")


LINE = register_contract(
    Contract(
        "order_line",
        "dimension",
        (Field("order_id", "key"), Field("line_no", "key"), Field("status", "text"), *VERSIONED),
        key=("order_id", "line_no"),
        compare=("status",),
    )
)
SHIPMENT = register_contract(
    Contract(
        "shipment",
        "fact",
        (Field("order_id", "key"), Field("line_no", "key"), Field("quantity", "number")),
    )
)
LINES_SQL = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS line_no,
         max(l_quantity) > 45 AS moved, CASE WHEN max(l_quantity) > 45 THEN 'N' ELSE max(l_returnflag) END AS status
  FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
LINE_SOURCE = Source("lines", "table", "order_line", {})


def _members(spark, sf_dir):
    """One row for each line. The largest of some texts needs sorted rows: these are brought
    together first, so that they are sorted once."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    members = items.repartition("l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber")
    return members.agg(F.max("l_quantity").alias("most"), F.max("l_returnflag").alias("flag"))


def _lines(members, late="N"):
    return members.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("string").alias("line_no"),
        F.when(F.col("most") > 45, late).otherwise(F.col("flag")).alias("status"),
        F.lit("2024-01-01").alias("valid_from"),
    )


@query(
    "refresh_composite_dimension",
    f"""WITH {LINES_SQL}
SELECT order_id, line_no, status, NOT moved AS is_current FROM lines
UNION ALL SELECT order_id, line_no, 'LATE', true FROM lines WHERE moved""",
)
def composite_dimension(spark, sf_dir):
    """A dimension of two key columns: loaded, some members changed, the change sent once
    more, and a batch that repeats every key, which is rejected as a whole."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    members = write_staged(_members(spark, sf_dir), name="lines")
    changed = _lines(members, "LATE")
    twice = changed.unionByName(_lines(members, "TWICE"))
    for number, (rows, at) in enumerate(((_lines(members), FIRST), (changed, SECOND), (changed, SECOND), (twice, SECOND))):
        refresh_batch(warehouse, "lines", LINE_SOURCE, rows, "run", f"batch-{number}", as_of=at)
    return warehouse.dimension("order_line").select("order_id", "line_no", "status", "is_current")


@query(
    "cube_composite_key",
    f"""WITH {LINES_SQL}
SELECT status, CAST(grouping_id(status) AS BIGINT) AS grouping_id, CAST(sum(l_quantity) AS DOUBLE) AS quantity,
       count(*) AS row_count
FROM lineitem JOIN lines ON order_id = CAST(l_orderkey AS VARCHAR) AND line_no = CAST(l_linenumber AS VARCHAR)
GROUP BY CUBE (status)""",
)
def cube_of_composite_key(spark, sf_dir):
    """Facts that reach their dimension by two columns, which members share one by one."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    refresh_batch(warehouse, "lines", LINE_SOURCE, _lines(_members(spark, sf_dir)), "run", "lines", as_of=FIRST)
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    shipped = table(spark, sf_dir, "lineitem").select(
        order.alias("order_id"),
        line.alias("line_no"),
        F.col("l_quantity").alias("quantity"),
    )
    refresh_batch(warehouse, "lines", Source("shipped", "table", "shipment", {}), shipped, "run", "shipped", as_of=FIRST)
    cube = Cube("lines", (), "shipment", ("order_line",), ("quantity",), (), {"order_line": ("status",)})
    rebuild_stale(warehouse, [cube])
    return warehouse.cube("lines").select(
        "status", F.col("grouping_id").cast("bigint").alias("grouping_id"), F.col("quantity").cast("double").alias("quantity"), "row_count"
    )
