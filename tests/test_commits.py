"""The commit log under several writers, and how much of it a reader opens."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from tests.fixtures import day
from tidemark.contracts import contract_named
from tidemark.plans import Cube, Job, Source, Warehouse, refresh
from tidemark.plans.commits import FOLD, CommitConflict, CommitLog, LocalFiles, SharedFiles

WRITER = """
import sys
sys.path.insert(0, {root!r})
from tidemark.plans.commits import FIELDS, CommitLog, LocalFiles
log = CommitLog(LocalFiles(), {base!r})
for k in range({n}):
    log.append(dict.fromkeys(FIELDS[1:]) | {{"batch_id": f"{name}-{{k}}", "source": {name!r}, "rows_inserted": k}})
"""


def entry(batch, **values):
    from tidemark.plans.commits import FIELDS

    return dict.fromkeys(FIELDS[1:]) | {"batch_id": batch} | values


def test_two_processes_lose_nothing_and_repeat_no_number(tmp_path):
    root, n = str(Path(__file__).resolve().parent.parent), 3 * FOLD
    base = str(tmp_path / "state")
    code = [WRITER.format(root=root, base=base, n=n, name=name) for name in ("one", "two", "three")]
    running = [subprocess.Popen([sys.executable, "-c", c]) for c in code]
    assert [p.wait(timeout=120) for p in running] == [0, 0, 0]
    rows = CommitLog(LocalFiles(), base).rows()
    assert [r["seq"] for r in rows] == list(range(1, 3 * n + 1))
    for name in ("one", "two", "three"):
        assert [r["batch_id"] for r in rows if r["source"] == name] == [f"{name}-{k}" for k in range(n)]
    interleaved = sum(a["source"] != b["source"] for a, b in zip(rows, rows[1:]))
    assert interleaved > 2


def test_a_reader_opens_a_bounded_number_of_files(tmp_path):
    opened = []

    class Counted(LocalFiles):
        def read(self, path):
            opened.append(path)
            return super().read(path)

    base = str(tmp_path)
    log = CommitLog(LocalFiles(), base)
    for k in range(1000):
        log.append(entry(f"b{k}", watermark=day(1 + k % 20)))
    late = CommitLog(Counted(), base)
    assert [r["batch_id"] for r in late.rows()] == [f"b{k}" for k in range(1000)]
    assert late.rows()[21]["watermark"] == day(2)
    assert 0 < len(opened) <= FOLD + 1 and len(late.paths()) <= FOLD + 1
    log.append(entry("last"))
    opened.clear()
    assert late.rows()[-1]["batch_id"] == "last" and len(opened) == 1


def test_a_lost_fold_costs_nothing_but_files(tmp_path):
    class NoFold(LocalFiles):
        def create(self, path, text):
            return False if "/folded/" in path else super().create(path, text)

    log = CommitLog(NoFold(), str(tmp_path))
    for k in range(2 * FOLD + 3):
        log.append(entry(f"b{k}"))
    again = CommitLog(LocalFiles(), str(tmp_path))
    again.append(entry("more"))
    assert len(CommitLog(LocalFiles(), str(tmp_path)).paths()) == 1
    assert len(CommitLog(LocalFiles(), str(tmp_path)).rows()) == 2 * FOLD + 4


def test_files_of_a_shared_store(spark, tmp_path):
    log = CommitLog(SharedFiles(spark, str(tmp_path)), str(tmp_path))
    for k in range(FOLD + 2):
        log.append(entry(f"bé{k}", committed_at=day(3)))
    assert not SharedFiles(spark, str(tmp_path)).create(log.paths()[-1], "other")
    rows = CommitLog(LocalFiles(), str(tmp_path)).rows()
    assert [r["batch_id"] for r in rows] == [f"bé{k}" for k in range(FOLD + 2)] and rows[0]["committed_at"] == day(3)


def test_conflicts(spark, tmp_path):
    one, two = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    seen = two.last_commit()
    one.commit("a", "sales", "s1", day(1), 1, 0, day(1))
    two.commit("b", "sales", "s2", day(1), 1, 0, day(1), seen=seen)  # another source appends
    with pytest.raises(CommitConflict):
        two.commit("c", "sales", "s1", day(1), 1, 0, day(1), seen=seen)  # the same rows, loaded by both
    with pytest.raises(CommitConflict):
        two.commit("d", "sales", "s3", day(1), 1, 0, day(1), seen=seen, depends=True)
    two.commit("e", "sales", "s1", day(2), 1, 0, day(2), seen=two.last_commit(), depends=True)
    assert [r["batch_id"] for r in one.commits_of("sales")] == ["a", "b", "e"]


def test_a_refresh_takes_its_batch_again(spark, tmp_path, monkeypatch):
    """Another refresh of the same source commits first: no row is loaded twice."""
    (tmp_path / "sales.csv").write_text(
        "id,product_id,customer_id,quantity,amount,sale_date,region\n1,P1,C1,2,20.0,2024-03-01,North\n2,P1,C2,1,10.0,2024-03-02,South\n"
    )
    job = Job((Source("sales_csv", "csv", "sales", {"path": str(tmp_path / "sales.csv")}, "sale_date"),), (Cube("sales", ("sales_csv",)),))
    base = str(tmp_path / "w")
    commit, others = Warehouse.commit, []

    def late(self, batch_id, table, *args, **kwargs):
        if table == contract_named("sales").table and not others:
            others.append(1)
            refresh(Warehouse(spark, base), job)
        return commit(self, batch_id, table, *args, **kwargs)

    monkeypatch.setattr(Warehouse, "commit", late)
    warehouse = Warehouse(spark, base)
    runs = refresh(warehouse, job).collect()
    assert [r["status"] for r in runs] == ["success"] and runs[0]["rows_inserted"] == 0
    assert sorted(r["id"] for r in warehouse.facts("sales").collect()) == ["1", "2"]
