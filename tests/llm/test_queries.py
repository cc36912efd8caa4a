"""The registered queries against SQL where it can state them, and their columns where it cannot."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from tests.llm.cases import SMALL
from tests.test_queries import bag
from tidemark.llm import queries

COLUMNS = {
    "op1_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4_compression_bands": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    "op5_best_fit_packing": {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint",
        "offset": "bigint",
    },
    "op6_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op7_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op11_super_kmers": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op12_prefix_trie": {
        "conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
        "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string",
    },
    "op13_limb_codes": {
        "vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string",
    },
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.EXPECTED))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = driver.queries()[name](spark, SMALL)
    cursor = connection.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert bag(columns, cursor.fetchall()) == bag(found.columns, [tuple(r) for r in found.collect()])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    types = dict(driver.queries()[name](spark, SMALL).dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
