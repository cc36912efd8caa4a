"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept and decides on all of it. All but the last return the
columns of ``documents``, with ``n_chars`` as the text is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_copies, packing, pii, quality, queries
from tidemark.session import scratch_path


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line in the first document that holds it only."""
    return _recounted(line_dedup.without_shared_lines(docs, scratch_path(spark, "stage-lines")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, found by SimHash tables and decided by their
    five-word shingles: that of the smallest id."""
    return near_copies.one_of_each(docs, scratch_path(spark, "stage-simhash"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return _recounted(pii.without_personal_data(docs, queries.pii_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its ids and its place in a sequence of 2048 tokens."""
    return packing.pack(docs, queries.BYTE_BPE, scratch_path(spark, "stage-packed"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_shared_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", pseudonymize),
    ("best-fit packing", pack),
]
#: The stages hash, compress and encode texts, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each one's rows written and read again."""
    docs = queries.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
