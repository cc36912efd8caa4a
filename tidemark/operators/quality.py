"""Validation of a batch against a contract.

Every function takes a frame of raw columns with a unique, ordered row column
(``_row`` or ``_pos``). Rules that look at one row are evaluated in one pass, which
leaves a narrow table of flags; the unique rule counts that table per key and only then
looks up the rows of keys seen twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import (
    DUPLICATE,
    REQUIRED_EMPTY,
    Contract,
    missing_required,
    raw_columns,
)
from tidemark.functions.coerce import is_json, json_text
from tidemark.functions.naming import any_of, member_of
from tidemark.operators.staging import HOT_ROWS, ROW, hot_keys, join_hot_apart, write_staged

ISSUES = "_issues"
BAD = "_bad"
TYPED = "_t_"

# Lines of the report, which readers of the run log match on.
ALL_PASSED = "All rows passed validation"
SOME_FAILED = "Validation failed: {} rows failed, {} rows passed"
ROW_START, LINE_START = "  Row ", "    - "


def _issue(order: int, name: str, message: Column, value: Column) -> Column:
    return F.struct(
        F.lit(order).alias("issue_no"),
        F.lit(name).alias("field"),
        message.alias("message"),
        value.cast("string").alias("value"),
    )


def check_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Adds the cast of every field (``_t_`` columns), the bad flag, and for a bad row the
    outcome of every rule as an array (NULL for a clean row; no message, no issue).

    Casts, then messages, then the array: each step reads the columns of the one before,
    so a value is parsed once however many rules look at it.
    """
    raw = raw_columns(df, contract)
    cast = df.withColumns({TYPED + f.name: f.cast(*raw[f.name]) for f in contract.fields})
    messages = {
        f"_m_{number}": (f.name, f.issue(raw[f.name][0], F.col(TYPED + f.name), raw[f.name][1]))
        for number, f in enumerate(contract.fields)
    }
    for number, name in enumerate(contract.required, start=len(contract.fields)):
        empty = F.when(missing_required(df, contract, name), F.lit(REQUIRED_EMPTY))
        messages[f"_m_{number}"] = (name, empty)
    told = cast.withColumns({column: message for column, (_, message) in messages.items()})
    every = F.array(
        *[
            _issue(number, name, F.col(column), json_text(raw[name][0]) if is_json(raw[name][1]) else raw[name][0])
            for number, (column, (name, _)) in enumerate(messages.items())
        ]
    )
    broken = any_of([F.col(column).isNotNull() for column in messages])
    return told.withColumns({ISSUES: F.when(broken, every), BAD: broken}).drop(*messages)


def flag_rows(df: DataFrame, contract: Contract, row: str = ROW) -> DataFrame:
    """Row column, unique fields, issues and bad flag of a batch, written out.

    All that follows reads this narrow table, and the batch itself is parsed once.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    others = [c for c in contract.unique_columns if c != row]
    unique = [F.col(TYPED + c).alias(c) if is_json(types.get(c)) else F.col(c) for c in others]
    flagged = check_rows(df, contract).select(row, *unique, ISSUES, BAD)
    return write_staged(flagged, name="flags")


def duplicate_keys(df: DataFrame, keys: Sequence[str], row: str = ROW) -> DataFrame:
    """Keys that occur more than once, the first row of each and the number of rows.
    Counted map-side first; missing values count as one more key."""
    counted = df.groupBy(*keys).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > 1)


def most_alike(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most of them, 0 for no rows.

    Hashes are counted instead of keys. No key has more rows than its hash, so the largest hash
    decides if it is single, or if all its rows are of one key. Only otherwise, where keys share
    it, the keys themselves are counted.
    """
    hashed = F.xxhash64(*keys)
    counted = df.select(hashed.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.max("n").alias("n"), F.max_by("h", "n").alias("h")).first()
    if (top["n"] or 0) < 2:
        return top["n"] or 0
    for rows in (df.filter(hashed == F.lit(top["h"])), df):
        by_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        most = by_key.agg(F.max("n").alias("n")).first()["n"]
        if most == top["n"]:
            break
    return most


def duplicate_rows(
    df: DataFrame, keys: Sequence[str], row: str = ROW, hot_rows: int = HOT_ROWS, most: int | None = None
) -> DataFrame:
    """All rows but the first of every repeated key.

    The repeated keys are counted and written out first. They are few or none in a sound
    batch, and with their real size known the rows are mostly looked up where they lie.
    Where ``most``, the rows of the most frequent key, is known and no key is hot, the rows
    are put in order key by key instead, in one shuffle however many keys are repeated.
    """
    if most is not None and most < hot_rows:
        if most < 2:
            return df.limit(0)
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(row)))
        return ranked.filter(F.col("_rank") > 1).drop("_rank")
    repeated = write_staged(duplicate_keys(df, keys, row), name="repeated")
    hot = hot_keys(repeated, keys, "n", hot_rows)
    found = join_hot_apart(df, repeated, keys, hot)
    return found.filter(F.col(row) > F.col("first_row")).drop("first_row", "n")


def unique_issues(
    flagged: DataFrame,
    contract: Contract,
    row: str = ROW,
    hot_rows: int = HOT_ROWS,
    most: Sequence[int] | None = None,
) -> list[DataFrame]:
    """Row column, bad flag and issue of every repeated row, a frame for each unique key.
    ``most``: :func:`most_alike` of each of them, where it is known already."""
    first = len(contract.fields) + len(contract.required)
    frames = []
    for at, names in enumerate(contract.unique_keys):
        number, known = first + at, None if most is None else most[at]
        again = duplicate_rows(flagged.select(*dict.fromkeys([row, *names]), BAD), names, row, hot_rows, known)
        value = F.col(names[0]) if len(names) == 1 else F.concat_ws(", ", *names)
        issue = _issue(number, ", ".join(names), F.lit(DUPLICATE), value)
        frames.append(again.select(row, BAD, issue.alias("issue")))
    return frames


def validate_errors(
    df: DataFrame, contract: Contract, row: str = ROW, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per issue: row column, ``issue_no`` (its place within the row), ``field``,
    ``message``, ``value``."""
    return flagged_errors(flag_rows(df, contract, row), contract, row, hot_rows)


def flagged_errors(
    flagged: DataFrame,
    contract: Contract,
    row: str = ROW,
    hot_rows: int = HOT_ROWS,
    again: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """``again``: the unique issues, where they are known already."""
    local = flagged.filter(BAD).select(row, F.explode(ISSUES).alias("issue")).filter("issue.message IS NOT NULL")
    again = unique_issues(flagged, contract, row, hot_rows) if again is None else again
    frames = [local] + [f.select(row, "issue") for f in again]
    return reduce(DataFrame.unionByName, frames).select(row, "issue.*")


def validate_counts(
    df: DataFrame, contract: Contract, row: str = ROW, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row: ``rows_processed``, ``rows_passed``, ``rows_failed``, ``valid``."""
    return flagged_counts(flag_rows(df, contract, row), contract, row, hot_rows)


def flagged_counts(
    flagged: DataFrame,
    contract: Contract,
    row: str = ROW,
    hot_rows: int = HOT_ROWS,
    again: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """``again``: the unique issues, where they are known already."""
    total = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(BAD).alias("failed"))
    again = unique_issues(flagged, contract, row, hot_rows) if again is None else again
    again = [f.filter(~F.col(BAD)).select(row) for f in again]
    parts = [total]
    if again:
        repeated = reduce(DataFrame.unionByName, again)
        if len(again) > 1:
            repeated = repeated.distinct()
        parts.append(repeated.agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("failed")))
    summed = reduce(DataFrame.unionByName, parts).agg(
        F.sum("n").alias("rows_processed"), F.sum("failed").alias("rows_failed")
    )
    return summed.select(
        "rows_processed",
        (F.col("rows_processed") - F.col("rows_failed")).alias("rows_passed"),
        "rows_failed",
        (F.col("rows_failed") == 0).alias("valid"),
    )


def quoted(value: Column) -> Column:
    """A reported value: bare when it reads as a number, a JSON string otherwise."""
    text = F.to_json(F.array(value))
    json = F.substring(text, F.lit(2), F.length(text) - 2)
    number = value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(value.isNull(), F.lit("undefined")).when(number, value).otherwise(json)


def error_report(errors: DataFrame, row: str = ROW) -> DataFrame:
    """One report block per failed row. A row's issues are bounded by its contract."""
    line = F.concat(
        F.lit(LINE_START), "field", F.lit(": "), "message", F.lit(" (value: "), quoted(F.col("value")), F.lit(")")
    )
    lines = F.array_sort(F.collect_list(F.struct("issue_no", line.alias("line"))))
    grouped = errors.groupBy(row).agg(F.count(F.lit(1)).alias("issues"), lines.alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda entry: entry["line"]), "\n")
    head = F.concat(F.lit(ROW_START), F.col(row).cast("string"), F.lit(":\n"))
    return grouped.select(row, "issues", F.concat(head, body).alias("report"))


def report_header(rows_failed: int, rows_passed: int) -> str:
    if rows_failed == 0:
        return ALL_PASSED
    return SOME_FAILED.format(rows_failed, rows_passed)


def validate_gate(batches: DataFrame, errors: DataFrame, by: str = "source") -> DataFrame:
    """Rows of the batches (told apart by ``by``) that have no error at all."""
    return member_of(batches, errors.select(by).distinct(), [by], "left_anti")
