"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.contracts import (
    CUSTOMER,
    SALES,
    Contract,
    Field,
    contract_named,
    field_issue,
    missing_required,
    register_contract,
    typed_projection,
)
from tidemark.operators.quality import (
    duplicate_keys,
    duplicate_rows,
    error_report,
    validate_counts,
    validate_errors,
    validate_gate,
)
from tidemark.operators.staging import batch_row_ordinal, ordered_batch
from tidemark.session import scratch_path
from tidemark.sources import read_source
from workload import query
from workload.roles import FEED_ERRORS_SQL, FEED_SQL, order_feed, table

ACCOUNT = Contract("account", "dimension", (Field("c_custkey", "key"), Field("c_acctbal", "number")), key=("c_custkey",))


@query(
    "typed_projection",
    f"""WITH {FEED_SQL}
SELECT _row, id, product_id, customer_id, TRY_CAST(quantity AS DOUBLE) AS quantity,
       TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(sale_date AS TIMESTAMP) AS sale_date, region,
       CAST(NULL AS TIMESTAMP) AS updated_at
FROM feed""",
)
def typed(spark, sf_dir):
    return typed_projection(order_feed(spark, sf_dir), SALES, keep=("_row",))


@query(
    "rule_type",
    f"""WITH {FEED_SQL}
SELECT _row, amount AS value, 'Expected number, received string' AS message
FROM feed WHERE TRY_CAST(amount AS DOUBLE) IS NULL""",
)
def rule_type(spark, sf_dir):
    feed = order_feed(spark, sf_dir)
    found = feed.select("_row", F.col("amount").alias("value"), field_issue(feed, SALES, "amount").alias("message"))
    return found.filter("message IS NOT NULL")


@query(
    "rule_positive",
    """SELECT c_custkey, c_acctbal, 'Number must be greater than 0' AS message FROM customer WHERE c_acctbal <= 0""",
)
def rule_positive(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    found = customer.select("c_custkey", "c_acctbal", field_issue(customer, ACCOUNT, "c_acctbal").alias("message"))
    return found.filter("message IS NOT NULL")


@query(
    "rule_nonempty",
    f"""WITH {FEED_SQL}
SELECT _row, 'String must contain at least 1 character(s)' AS message FROM feed WHERE region = ''""",
)
def rule_nonempty(spark, sf_dir):
    feed = order_feed(spark, sf_dir)
    return feed.select("_row", field_issue(feed, SALES, "region").alias("message")).filter("message IS NOT NULL")


MAIL_SQL = """
mails AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN ''
              WHEN c_mktsegment = 'MACHINERY' THEN NULL
              WHEN c_acctbal < 0 THEN '.' || lower(replace(c_name, '#', '.')) || '@example.com'
              WHEN c_acctbal > 9500 THEN lower(replace(c_name, '#', '..')) || '@example.com'
              WHEN c_acctbal > 9000 THEN lower(c_name) || '@example.com'
              WHEN c_acctbal > 8500 THEN lower(replace(c_name, '#', '.')) || '@example'
              ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email
  FROM customer)
"""


def _mails(spark, sf_dir):
    name, balance, segment = F.lower("c_name"), F.col("c_acctbal"), F.col("c_mktsegment")
    dotted = F.replace(name, F.lit("#"), F.lit("."))
    mail = (
        F.when(segment == "FURNITURE", "")
        .when(segment == "MACHINERY", F.lit(None))
        .when(balance < 0, F.concat(F.lit("."), dotted, F.lit("@example.com")))
        .when(balance > 9500, F.concat(F.replace(name, F.lit("#"), F.lit("..")), F.lit("@example.com")))
        .when(balance > 9000, F.concat(name, F.lit("@example.com")))
        .when(balance > 8500, F.concat(dotted, F.lit("@example")))
        .otherwise(F.concat(dotted, F.lit("@example.com")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", mail.alias("email"))


@query(
    "rule_email",
    f"""WITH {MAIL_SQL}
SELECT c_custkey, email, 'Invalid email' AS message FROM mails JOIN customer USING (c_custkey)
WHERE c_mktsegment = 'FURNITURE' OR c_mktsegment <> 'MACHINERY' AND (c_acctbal < 0 OR c_acctbal > 8500)""",
)
def rule_email(spark, sf_dir):
    mails = _mails(spark, sf_dir)
    found = mails.select("c_custkey", "email", field_issue(mails, CUSTOMER, "email").alias("message"))
    return found.filter("message IS NOT NULL")


@query(
    "rule_date",
    f"""WITH {FEED_SQL}
SELECT _row, sale_date AS value, 'Invalid date' AS message FROM feed WHERE TRY_CAST(sale_date AS TIMESTAMP) IS NULL""",
)
def rule_date(spark, sf_dir):
    feed = order_feed(spark, sf_dir)
    found = feed.select("_row", F.col("sale_date").alias("value"), field_issue(feed, SALES, "sale_date").alias("message"))
    return found.filter("message IS NOT NULL")


@query(
    "rule_required",
    f"""WITH {FEED_SQL}
SELECT _row, product_id IS NULL OR product_id = '' AS no_product, customer_id IS NULL OR customer_id = '' AS no_customer
FROM feed WHERE product_id IS NULL OR product_id = '' OR customer_id IS NULL OR customer_id = ''""",
)
def rule_required(spark, sf_dir):
    feed = order_feed(spark, sf_dir)
    flags = feed.select(
        "_row",
        missing_required(feed, SALES, "product_id").alias("no_product"),
        missing_required(feed, SALES, "customer_id").alias("no_customer"),
    )
    return flags.filter("no_product OR no_customer")


@query(
    "rule_unique",
    """SELECT o_orderkey, o_custkey
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1""",
)
def rule_unique(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return duplicate_rows(orders, ["o_custkey"], row="o_orderkey")


@query(
    "rule_unique_composite",
    """SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_row, count(*) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def rule_unique_composite(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], row="l_partkey")


@query("validate_errors", f"WITH {FEED_ERRORS_SQL} SELECT * FROM errors")
def errors(spark, sf_dir):
    return validate_errors(order_feed(spark, sf_dir), SALES)


@query(
    "validate_counts",
    f"""WITH {FEED_ERRORS_SQL},
failed AS (SELECT count(DISTINCT _row) AS n FROM errors), total AS (SELECT count(*) AS n FROM feed)
SELECT total.n AS rows_processed, total.n - failed.n AS rows_passed, failed.n AS rows_failed, failed.n = 0 AS valid
FROM total, failed""",
)
def counts(spark, sf_dir):
    return validate_counts(order_feed(spark, sf_dir), SALES)


@query(
    "validate_gate",
    f"""WITH {FEED_ERRORS_SQL}
SELECT feed.* FROM feed
WHERE customer_id IS NOT NULL AND customer_id NOT IN (
  SELECT f.customer_id FROM errors e JOIN feed f ON e._row = f._row WHERE f.customer_id IS NOT NULL)""",
)
def gate(spark, sf_dir):
    """Each customer sends a batch of its own; one bad row keeps the whole batch out."""
    feed = order_feed(spark, sf_dir)
    failed = validate_errors(feed, SALES).join(feed.select("_row", "customer_id"), "_row")
    return validate_gate(feed, failed, by="customer_id")


@query(
    "error_report",
    f"""WITH {FEED_ERRORS_SQL}
SELECT _row, count(*) AS issues,
       '  Row ' || CAST(_row AS VARCHAR) || ':' || chr(10) ||
       string_agg('    - ' || field || ': ' || message || ' (value: ' ||
                  CASE WHEN value IS NULL THEN 'undefined'
                       WHEN regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN value
                       ELSE '"' || value || '"' END || ')', chr(10) ORDER BY issue_no) AS report
FROM errors GROUP BY _row""",
)
def report(spark, sf_dir):
    return error_report(validate_errors(order_feed(spark, sf_dir), SALES))


SUPPLIER = register_contract(
    Contract(
        "supplier",
        "dimension",
        (Field("s_suppkey", "key"), Field("s_name", "text"), Field("s_acctbal", "number")),
        required=("s_suppkey", "s_name"),
        unique=("s_name",),
        key=("s_suppkey",),
        compare=("s_name", "s_acctbal"),
    )
)


@query(
    "custom_contract",
    """SELECT s_suppkey, 2 AS issue_no, 's_acctbal' AS field, 'Number must be greater than 0' AS message,
       CAST(CAST(s_acctbal AS DECIMAL(18,2)) - 5000 AS VARCHAR) AS value
FROM supplier WHERE s_acctbal <= 5000""",
)
def custom_contract(spark, sf_dir):
    """A contract of the user's own, over typed columns: a balance less a reserve of 5000."""
    spare = F.col("s_acctbal").cast("decimal(18,2)") - 5000
    supplier = table(spark, sf_dir, "supplier").withColumn("s_acctbal", spare)
    return validate_errors(supplier, contract_named("supplier"), row="s_suppkey")


@query(
    "batch_row_ordinal",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row FROM orders",
)
def ordinal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return batch_row_ordinal(ordered_batch(orders, ["o_orderkey"])).select("o_orderkey", "_row")


READING = Contract(
    "reading", "fact", (Field("id", "key"), Field("amount", "number"), Field("kind", "text"), Field("seen_at", "date"))
)


@query(
    "rule_type_json",
    """SELECT event_id AS _row, field, message, value FROM (
  SELECT event_id, 'amount' AS field, 'Expected number, received string' AS message, CAST(user_id AS VARCHAR) AS value
  FROM events WHERE event_type = 'error'
  UNION ALL
  SELECT event_id, 'kind', 'Expected string, received number', CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT event_id, 'seen_at', 'Invalid date', 'true' FROM events WHERE event_type = 'signup')""",
)
def json_types(spark, sf_dir):
    """Records whose JSON types are right or wrong by the kind of event: an amount as text, a
    name as a number, a flag for a date; dates are milliseconds otherwise."""
    event = F.col("event_type")
    user = F.col("user_id").cast("string")
    quoted = F.concat(F.lit('"'), user, F.lit('"'))
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    record = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"),
        F.lit(', "amount": '), F.when(event == "error", quoted).otherwise(F.concat(user, F.lit(".5"))),
        F.lit(', "kind": '), F.when(event == "purchase", user).otherwise(quoted),
        F.lit(', "seen_at": '), F.when(event == "signup", "true").otherwise(millis), F.lit("}"),
    )
    path = scratch_path(spark, "readings")
    table(spark, sf_dir, "events").select(record).write.text(path)
    rows = read_source(spark, "json", {"path": path, "records": "lines"}, READING)
    numbered = rows.withColumn("_row", F.try_variant_get("id", "$", "bigint"))
    return validate_errors(numbered, READING).select("_row", "field", "message", "value")
