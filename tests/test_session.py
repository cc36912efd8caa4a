from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidemark.session import scratch_path, scratch_root


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used():
    assert scratch_root(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    first, second = (scratch_path(session("yarn", "/shared"), "x") for _ in range(2))
    assert first.startswith("/shared/tidemark/x-") and first != second


def test_only_a_local_master_may_go_without():
    assert scratch_root(session("local[2]")) == scratch_root(session("local[*]"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch_root(session("spark://host:7077"))
