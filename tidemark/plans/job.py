"""One refresh: extract, check, load, commit, log, invalidate, rebuild.

The functions here decide and write; all row work is done by the operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.contracts import Contract, contract_named
from tidemark.operators.cubes import DimensionJoin, build_cube, cube_of_grain, grain_of_collapsed
from tidemark.operators.quality import (
    BAD,
    ISSUES,
    TYPED,
    check_rows,
    error_report,
    flagged_errors,
    most_alike,
    report_header,
    unique_issues,
)
from tidemark.operators.staging import POSITION, ROW, batch_row_ordinal, with_position, write_staged
from tidemark.operators.state import Run
from tidemark.operators.upsert import absent_rows
from tidemark.plans.commits import CommitConflict
from tidemark.plans.config import Cube, Job, Source
from tidemark.plans.grains import collapsed_facts
from tidemark.plans.warehouse import Warehouse, utc_now
from tidemark.sources.csv import CORRUPT
from tidemark.sources.marks import effective_mark, incremental_filter, late_rows, mark_of
from tidemark.sources.registry import read_source

# A failed run's log entry quotes this many rows and says where the others are; the errors
# table holds all of them.
REPORTED_ROWS = 20

# A batch is taken again so often in all where other writers commit first.
ATTEMPTS = 5

_MARK = "_mark"
# Source named in the run record of a rebuild that failed.
REBUILD = "(rebuild)"


def _mark_column(contract: Contract, watermark_column: str | None, given: Iterable[str] = ()) -> str:
    """Staged column that holds the mark: the contract's own date where it is one and is the row's."""
    dates = {f.name for f in contract.fields if f.kind == "date"} - set(given)
    return watermark_column if watermark_column in dates else _MARK


def stage_batch(
    raw: DataFrame,
    contract: Contract,
    watermark_column: str | None,
    path: str,
    order_by: Sequence[str] = (),
    given: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Typed columns, issues and mark of a batch, written once under ``path``, in the order
    of ``order_by`` if it names columns. ``given``: columns that get these values, not the row's.

    Everything a single row can tell is decided in the pass that writes it, so the gate
    reads flags instead of parsing the source again.
    """
    given = given or {}
    typed = {f.name: f.filled(F.col(TYPED + f.name)) for f in contract.fields}
    columns = [
        *[value.alias(name) for name, value in {**typed, **given}.items()],
        ISSUES,
        BAD,
        F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string").alias(CORRUPT),
    ]
    if _mark_column(contract, watermark_column, given) == _MARK:
        if _mark_column(contract, watermark_column) != _MARK:
            mark = typed[watermark_column]
        else:
            mark = mark_of(raw, watermark_column) if watermark_column else F.lit(None).cast("timestamp_ntz")
        columns.append(mark.alias(_MARK))
    checked = check_rows(raw, contract).select(*columns)
    if order_by:
        checked = checked.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return with_position(write_staged(checked, path=path))


def _batch_facts(staged: DataFrame, mark_column: str) -> Row:
    return staged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(BAD).alias("bad"),
        F.count(CORRUPT).alias("corrupt"),
        F.max(mark_column).alias("mark"),
    ).first()


def _keep_malformed(warehouse: Warehouse, source: Source, staged: DataFrame, batch_id: str) -> None:
    """Write the records that could not be read as rows, with their text."""
    records = batch_row_ordinal(staged).filter(F.col(CORRUPT).isNotNull())
    errors = records.select(
        F.lit(source.name).alias("source"),
        ROW,
        F.lit(0).alias("issue_no"),
        F.lit(None).cast("string").alias("field"),
        F.lit("Malformed record").alias("message"),
        F.col(CORRUPT).alias("value"),
    )
    warehouse.write_errors(errors, batch_id)


def _reject(
    warehouse: Warehouse, source: Source, contract: Contract, staged: DataFrame, batch_id: str, facts: Row, most: Sequence[int]
) -> list[str]:
    """Write all issues of the batch and return the log lines of the first rows. ``most``: rows of
    the most frequent key, for each unique key."""
    flagged = batch_row_ordinal(staged).select(ROW, *contract.unique_columns, ISSUES, BAD)
    again = unique_issues(flagged, contract, most=most)
    by_row = flagged if facts["bad"] else flagged.limit(0)
    errors = flagged_errors(by_row, contract, again=again).withColumn("source", F.lit(source.name))
    warehouse.write_errors(errors, batch_id)
    stored = warehouse.errors().filter(F.col("_batch_id") == batch_id)
    # A row may have several issues, unless they are all of one unique key.
    failing = stored.select(ROW) if len(again) == 1 and not facts["bad"] else stored.select(ROW).distinct()
    failed = failing.count()
    # No row has more issues than there are rules, so the first rows are among so many of the first issues.
    rules = len(contract.fields) + len(contract.required) + len(contract.unique_keys)
    first = stored.select(ROW).orderBy(ROW).limit(REPORTED_ROWS * rules).distinct().orderBy(ROW).limit(REPORTED_ROWS)
    blocks = error_report(stored.join(F.broadcast(first), ROW, "left_semi")).orderBy(ROW).collect()
    lines = [report_header(failed, facts["rows"] - failed), *[b["report"] for b in blocks]]
    others = failed - len(blocks)
    return [*lines, f"  {others} more rows in the errors of batch {batch_id}"] if others > 0 else lines


def refresh_batch(
    warehouse: Warehouse,
    cube: str,
    source: Source,
    raw: DataFrame,
    run_id: str,
    batch_id: str,
    mark: datetime | None = None,
    as_of: datetime | None = None,
    keep_late: bool = False,
    seen: int | None = None,
) -> Run:
    """Take one batch of raw rows through the whole pipeline; returns its run record.

    ``seen`` is the last commit that ``mark`` was read from, by default the last one now; a commit
    after it that the batch would have had to know raises :class:`CommitConflict`.

    Only rows past ``mark`` count, all rows when there is none. With ``keep_late`` the others
    go to the late table, and the record says how many they are.
    """
    started = utc_now()
    contract = contract_named(source.schema)

    def record(status: str, processed=0, inserted=0, updated=0, reached=None, errors=None) -> Run:
        return Run(
            run_id, cube, source.name, started, utc_now(), processed, inserted, updated, reached, status, errors
        )

    seen = warehouse.last_commit() if seen is None else seen
    batch = incremental_filter(raw, source.watermark_column, mark)
    notes = None
    if keep_late and source.watermark_column and mark:
        late = warehouse.write_late(late_rows(raw, source.watermark_column, mark), source.name, batch_id)
        notes = [f"{late} late rows under batch {batch_id}"] if late else None
    # A plain fact batch is staged where it will stay: nobody reads it before its commit.
    in_place = contract.role == "fact" and not source.insert_if_absent
    path = warehouse.fact_batch_path(contract, batch_id) if in_place else f"{warehouse.base}/stage/{batch_id}"
    # So are the first versions of a dimension.
    table = warehouse.dimension_table(contract.name) if contract.role == "dimension" else None
    first = table is not None and table.starts_in_place(source.order_by)
    given = table.first_values(batch_id, as_of or started) if first else {}
    path = table.first_path(batch_id) if first else path
    staged = stage_batch(batch, contract, source.watermark_column, path, source.order_by, given)
    facts = _batch_facts(staged, _mark_column(contract, source.watermark_column, given))
    if facts["corrupt"]:
        _keep_malformed(warehouse, source, staged, batch_id)
        return record("failed", errors=[f"{facts['corrupt']} malformed records in source {source.name}"])
    if facts["rows"] == 0:
        return record("success", errors=notes)
    most = [most_alike(staged, k) for k in contract.unique_keys]
    if facts["bad"] or max(most, default=0) > 1:
        lines = _reject(warehouse, source, contract, staged, batch_id, facts, most)
        return record("failed", processed=facts["rows"], errors=lines)

    inserted, updated, rebased = facts["rows"], 0, False
    clean = staged.select(*contract.columns, POSITION)
    if first:
        inserted, updated, rebased = table.start(batch_id, facts["rows"])
    elif table is not None:
        inserted, updated, rebased = table.merge(clean.drop(POSITION), batch_id, as_of or started, facts["rows"])
    elif not in_place:
        stored = warehouse.facts_holding(contract, clean.select(*contract.key))
        fresh = absent_rows(stored, clean, contract.key, [F.col(POSITION)])
        warehouse.append_facts(contract, fresh.drop(POSITION), batch_id, source.watermark_column)
        inserted = warehouse.fact_batch(contract, batch_id).count()
    reached = facts["mark"] if source.watermark_column else None
    warehouse.commit(
        batch_id, contract.table, source.name, reached, inserted, updated, utc_now(), rebased, seen=seen, depends=not in_place
    )
    return record("success", facts["rows"], inserted, updated, reached, notes)


def rebuild_cube(warehouse: Warehouse, cube: Cube) -> None:
    """Aggregate the facts anew over the dimensions.

    Over current versions the sums of earlier batches by dimension key still hold, so only
    the facts that came since are read; the dimensions are joined to the sums.
    """
    if not cube.measures or not cube.by:
        return
    covers = warehouse.last_change(cube.tables)
    fact_columns = set(contract_named(cube.fact).columns)
    dimensions = []
    for name in cube.dimensions:
        key = contract_named(name).key
        if not set(key) <= fact_columns:
            raise ValueError(f"cube {cube.name}: the facts lack part of the key {key} of {name}")
        frame = warehouse.dimension(name) if cube.versions_at else warehouse.current(name)
        dimensions.append(DimensionJoin(frame, key, key, cube.attributes_of(name), cube.versions_at))
    if cube.versions_at:
        built = build_cube(warehouse.facts(cube.fact), dimensions, cube.by, cube.measures)
    else:
        collapsed = collapsed_facts(warehouse, cube, dimensions)
        grain = grain_of_collapsed(collapsed, dimensions, cube.by, cube.measures)
        built = cube_of_grain(grain, cube.by, cube.measures)
    warehouse.write_cube(cube.name, built, f"{cube.name}-{uuid.uuid4().hex}", utc_now(), covers)


def invalidate_loaded(warehouse: Warehouse, cube: Cube, runs: Iterable[Run]) -> bool:
    """Mark a cube as out of date if some source of it brought rows."""
    loaded = [r.source for r in runs if r.source in cube.sources and (r.rows_inserted or r.rows_updated)]
    if loaded:
        warehouse.invalidate(cube.name, loaded, utc_now(), "source brought rows")
    return bool(loaded)


def rebuild_stale(warehouse: Warehouse, cubes: Iterable[Cube]) -> list[str]:
    """Rebuild the cubes whose inputs changed, or that were invalidated, since they were built."""
    stale = [cube for cube in cubes if warehouse.is_stale(cube.name, cube.tables)]
    for cube in stale:
        rebuild_cube(warehouse, cube)
    return [cube.name for cube in stale]


def _rebuild_logged(warehouse: Warehouse, cube: Cube, run_id: str) -> None:
    """Rebuild a stale cube; a failure is logged, leaves the cube stale and stops no other."""
    started = utc_now()
    try:
        rebuild_stale(warehouse, [cube])
    except Exception as error:  # noqa: BLE001 - one cube that fails must not stop the rest
        failed = Run(run_id, cube.name, REBUILD, started, utc_now(), 0, 0, 0, None, "failed", [str(error)])
        warehouse.log_run(failed)


def _refresh_source(
    warehouse: Warehouse, cube: Cube, source: Source, run_id: str, since: datetime | None, as_of: datetime | None
) -> Run:
    started = utc_now()
    try:
        contract = contract_named(source.schema)
        for attempt in range(1, ATTEMPTS + 1):
            seen = warehouse.last_commit()
            mark = effective_mark(since, warehouse.watermark(source.name))
            past = (source.watermark_column, mark) if source.watermark_column and mark else None
            raw = read_source(warehouse.spark, source.kind, dict(source.options), contract, past)
            batch_id = f"{source.name}-{uuid.uuid4().hex}"
            try:
                return refresh_batch(warehouse, cube.name, source, raw, run_id, batch_id, mark, as_of, seen=seen)
            except CommitConflict:
                if attempt == ATTEMPTS:
                    raise
    except Exception as error:  # noqa: BLE001 - one bad source must not stop the rest
        return Run(run_id, cube.name, source.name, started, utc_now(), 0, 0, 0, None, "failed", [str(error)])


def refresh(
    warehouse: Warehouse,
    job: Job,
    cube_name: str | None = None,
    since: datetime | None = None,
    as_of: datetime | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Refresh one cube, or all of them; returns the run records.

    A source that fails is logged and does not stop the others. A source that several
    cubes share is loaded once, and invalidates all of them: the later cubes log that it had
    nothing more to give. In the end every cube asked for whose inputs have changed since it
    was built is rebuilt, also if another call or a lost job brought the change.
    """
    run_id = run_id or uuid.uuid4().hex
    done: dict[str, Run] = {}
    cubes = job.cubes_named(cube_name)
    for cube in cubes:
        fresh = []
        for source in job.sources_of(cube):
            if source.name in done:
                first = done[source.name]
                run = first._replace(cube=cube.name, rows_processed=0, rows_inserted=0, rows_updated=0)
            else:
                run = done[source.name] = _refresh_source(warehouse, cube, source, run_id, since, as_of)
                fresh.append(run)
            warehouse.log_run(run)
        for other in job.cubes:
            invalidate_loaded(warehouse, other, fresh)
    for cube in cubes:
        _rebuild_logged(warehouse, cube, run_id)
    return warehouse.runs().filter(F.col("run_id") == run_id)
