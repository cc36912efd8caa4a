"""Smallest and largest mark of every file of a Parquet table, kept beside it.

An incremental read asks the manifest which files hold rows past a mark and opens no other; the late rows
and the high-water mark come the same way. Files that came since are read once, for their marks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.marks import incremental_filter, instant_literal, late_rows, mark_of

MARKS = "file string, lo timestamp_ntz, hi timestamp_ntz, row_count bigint, unreadable bigint"


def _named(file: str) -> str:
    """A file as its rows' metadata name it: listings give local ones an empty host."""
    return "file:/" + file.removeprefix("file:").lstrip("/") if file.startswith("file:") else file


class FileMarks:
    """``path``: the table, ``manifest``: a folder for the marks of its files, ``column``: the mark."""

    def __init__(self, spark: SparkSession, path: str, manifest: str, column: str) -> None:
        self.spark, self.path, self.manifest, self.column = spark, path, manifest, column

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(MARKS).parquet(self.manifest)
        except Exception as error:  # noqa: BLE001 - the class differs between classic and Connect
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MARKS)

    def files(self) -> DataFrame:
        """The marks of all files that the table has now; those of new ones are added to the manifest first."""
        there = {_named(f) for f in self.spark.read.parquet(self.path).inputFiles()}
        known = {row["file"] for row in self._stored().select("file").collect()}
        new = sorted(there - known)
        if new:
            rows = self.spark.read.parquet(*new)
            mark = mark_of(rows, self.column)
            marks = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
                F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count(F.lit(1)).alias("row_count"), F.count_if(mark.isNull()).alias("unreadable")
            )
            marks.write.mode("append").parquet(self.manifest)
        stored = self._stored().groupBy("file").agg(*[F.max(c).alias(c) for c in ("lo", "hi", "row_count", "unreadable")])
        return stored.join(self.spark.createDataFrame([(f,) for f in there], "file string"), "file", "left_semi") if known - there else stored

    def _read(self, files: DataFrame) -> DataFrame:
        names = sorted(row["file"] for row in files.select("file").collect())
        return self.spark.read.parquet(*names) if names else self.spark.read.parquet(self.path).limit(0)

    def past(self, mark: datetime | None) -> DataFrame:
        """Rows past the mark, from files that hold one; all rows while there is no mark."""
        if mark is None:
            return self.spark.read.parquet(self.path)
        return incremental_filter(self._read(self.files().filter(F.col("hi") >= instant_literal(mark))), self.column, mark)

    def late(self, mark: datetime) -> DataFrame:
        """Rows at or below the mark, from files that hold one."""
        return late_rows(self._read(self.files().filter(F.col("lo") <= instant_literal(mark))), self.column, mark)

    def high_water_mark(self) -> DataFrame:
        """One row: the latest readable mark of the table, from the manifest alone."""
        return self.files().agg(F.max("hi").alias("high_water_mark"))
