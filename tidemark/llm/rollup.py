"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change is a row with a sign: an insert adds a document's tokens, a delete takes them away, a
revised count is one of each. A batch of changes is summed by key with partial sums in every task
and added to the totals, which hold one row per key however many documents there are.

A batch is committed once, under its own name. Its totals are written to a new folder first; the
one row that then names folder and batch in the log makes both count. A job lost before that row
leaves a folder nobody reads, a batch that comes again after it changes nothing.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_schema, type_of
from tidemark.llm.tokens import ID, encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
LOG = "version long, batch string, folder string"


@cache
def counter(path: str, pattern: str | None) -> Callable[[str | None], int]:
    """Counts the tokens of a text by a tokenizer file, or by a file of ranks and its splitting pattern."""
    if not path.endswith(".tiktoken"):
        encode = encoder(path).ids
        return lambda text: len(encode(text)) // ID.itemsize
    with open(path, "rb") as source:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
    ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(ranked.encode_ordinary(text or ""))


def counted(
    docs: DataFrame, path: str, tokenizer: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens of every row, by the tokenizer file at ``path``.

    ``pattern`` splits texts for a file of ranks (``.tiktoken``). A missing text has no tokens; missing sources and languages are keys of their own.
    """
    names = {id_col: "doc_id", text_col: "text", "source": "source", "lang": "lang"}
    given = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    result = f"doc_id {type_of(given, 'doc_id')}, source string, lang string, tokenizer string, n_tokens long"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for b in source:
            counts = pa.array([count(x.as_py()) for x in b.column(1)], pa.int64())
            names = pa.array([tokenizer] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), names, counts], schema=schema)

    return given.mapInArrow(run, result)


class Version(NamedTuple):
    """A tokenizer version: its name, file, and for a file of ranks the pattern that splits texts."""

    name: str
    path: str
    pattern: str | None = None


def counted_twice(
    docs: DataFrame, old: Version, new: Version, again: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, source, lang, ``old`` and ``new`` of every row: tokens by each version, by the new one where ``again`` holds and null elsewhere.

    One pass over the rows, so that what is taken from the totals and what is put back are the same
    rows, also where ids are missing or repeat. A missing text has no tokens.
    """
    names = {id_col: "doc_id", text_col: "text", "source": "source", "lang": "lang"}
    given = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.coalesce(again, F.lit(False)).alias("again"))
    result = f"doc_id {type_of(given, 'doc_id')}, source string, lang string, old long, new long"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = counter(old.path, old.pattern), counter(new.path, new.pattern)
        for b in source:
            before = pa.array([first(x.as_py()) for x in b.column(1)], pa.int64())
            after = pa.array([second(x.as_py()) if y.as_py() else None for x, y in zip(b.column(1), b.column(4))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), before, after], schema=schema)

    return given.mapInArrow(run, result)


def tokens_of(counts: DataFrame, column: str, version: Version) -> DataFrame:
    """source, lang, tokenizer and n_tokens by one of the columns of :func:`counted_twice`."""
    return counts.select("source", "lang", F.lit(version.name).alias("tokenizer"), F.col(column).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Every row as one document more; a missing count is no token, an empty table no change."""
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    """Every row as one document less, a repeated row as two."""
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Takes the old counts away and adds the new ones, which may name another tokenizer version."""
    return deletes(old).unionByName(inserts(new))


class TokenTotals:
    """The totals below ``folder``; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def batches(self) -> DataFrame:
        """Committed batches in order: ``version``, ``batch``, ``folder``."""
        return self._log()

    def totals(self) -> DataFrame:
        """One row per key with a document or a token, as of the last commit."""
        last = self._log().orderBy(F.desc("version")).first()
        return self.spark.read.schema(TOTALS).parquet(last.folder) if last else self.spark.createDataFrame([], TOTALS)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and no change, if its name was committed before.

        ``changes``: source, lang, tokenizer, n_tokens and sign; other columns are ignored, rows
        without a count count no token, rows without a sign are no change.
        """
        log = self._log()
        if log.filter(F.col("batch") == batch).take(1):
            return False
        signed = changes.filter("sign is not null").groupBy(*KEYS).agg(
            F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens")
        )
        new = self.totals().unionByName(signed).groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        folder = f"{self.folder}/totals-{uuid.uuid4().hex}"
        new.filter(" or ".join(f"{c} != 0" for c in SUMS)).write.parquet(folder)
        version = (log.agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(version, batch, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return True
