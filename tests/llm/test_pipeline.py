"""The whole pipeline against the plain readings of its stages, one after the other."""

from __future__ import annotations

from collections import defaultdict, namedtuple

import numpy as np

import __spark_entry__ as driver
import corpus_pipeline
from tests.llm import cases, test_lines, test_near_copies, test_tokens
from tidemark.llm import pii, quality, queries

Doc = namedtuple("Doc", "doc_id text")


def plain(rows):
    rules = quality.Rules()
    docs = [Doc(r.doc_id, r.text) for r in rows if rules.measure(r.text)[-1]]
    docs = [Doc(d[0], d[3]) for d in test_lines.plain(docs)]
    redactor = pii.Redactor(queries.TRIAL_KEY.encode())
    return {d.doc_id: test_tokens.plain(redactor.replaced(d.text)[0]) for d in test_near_copies.first_of_each(docs)}


def test_pipeline(spark):
    found = driver.queries()["pipeline"](spark, cases.SMALL)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in found.collect():
        pieces[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048
    expected = plain(queries.documents(spark, cases.SMALL).collect())
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in pieces.items()} == expected


def test_stages_keep_the_columns_and_take_awkward_documents(spark):
    docs = cases.known(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, cases.SMALL)
        assert out.schema == docs.schema and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), cases.SMALL).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"
    ]


def test_every_operator_has_its_query():
    numbers = {int(n[2:].split("_")[0]) for n in driver.queries() if n.startswith("op") and n[2].isdigit()}
    assert numbers == set(range(1, 14))
