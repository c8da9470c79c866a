"""Pages of reports that are too large to rank for each page.

A report is written once in its order, with the number of rows of every file
(``sources.keyed``). A position is then a file and a row in it: a page reads the
files that hold its positions, and no others. A filtered view counts once per
file what matches and finds its positions by those counts; sorted the other way
round, positions count from the end.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions.regex import report_filter
from lodestone.operators.report import Report
from lodestone.sources.keyed import Keyed, write_keyed
from lodestone.sources.store import materialise


class Paged:
    """A report's rows in the order of one column, missing values first, then of source_row; some of them where a pattern is given."""

    def __init__(self, spark: SparkSession, path: str, descending: bool = False, pattern: str | None = None, column: str | None = None) -> None:
        self.spark, self.path, self.descending, self.pattern, self.column = spark, path, descending, pattern, column
        self.keyed = Keyed(spark, path)
        counts = self._matching_counts()
        self.files = self.keyed.files
        self.counts = [counts.get(f, 0) for f in self.files]
        self.ends = list(accumulate(self.counts))
        self.size = self.ends[-1] if self.ends else 0

    @classmethod
    def write(cls, report: Report, column: str, path: str, partitions: int | None = None) -> Paged:
        others = [c for c in report.rows.columns if c not in (column, "source_row")]
        write_keyed(report.rows.select(column, "source_row", *others), path, [column, "source_row"], partitions)
        return cls(report.rows.sparkSession, path)

    def reversed(self) -> Paged:
        return Paged(self.spark, self.path, not self.descending, self.pattern, self.column)

    def filter(self, column: str, pattern: str) -> Paged:
        """The rows whose column matches, at positions of their own; replaces an earlier filter."""
        return Paged(self.spark, self.path, self.descending, pattern, column)

    def _kept(self) -> Column:
        return F.coalesce(report_filter(F.col(self.column), self.pattern), F.lit(False)) if self.pattern else F.lit(True)

    def _matching_counts(self) -> dict[str, int]:
        """Rows of the view in each file; a pass over the filtered column only."""
        if not self.keyed.files:
            return {}
        if not self.pattern:
            return {r["file"]: r["rows"] for r in self.spark.read.parquet(f"{self.path}/_keys").select("file", "rows").collect()}  # a row per file
        rows = self.keyed.rows(self.keyed.files).where(self._kept()).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
        return {r["file"]: r["rows"] for r in rows.collect()}  # a row per file

    def _numbered(self, files: list[str]) -> DataFrame:
        """Rows of some files with source_position (in the whole report) and position (in the view)."""
        rows = self.keyed.rows(files)
        rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        all_ = dict(zip(self.files, accumulate([0, *(r for r in self._sizes())]), strict=False))
        own = dict(zip(self.files, [0, *self.ends], strict=False))
        offsets = self.spark.createDataFrame([(f, all_[f], own[f]) for f in files], "_file string, _all long, _own long")
        placed = rows.join(F.broadcast(offsets), "_file").where(self._kept())  # a row per file
        index = F.row_number().over(W.partitionBy("_file").orderBy("_row")) - 1 if self.pattern else F.col("_row")
        place = lambda base, at, total: (F.lit(total - 1) - base - at if self.descending else base + at).cast("bigint")
        return placed.withColumn("source_position", place(F.col("_all"), F.col("_row"), sum(self._sizes()))).withColumn("position", place(F.col("_own"), index, self.size)).drop("_file", "_row", "_all", "_own")

    def _none(self) -> DataFrame:
        return self.keyed.rows([]).withColumns({c: F.lit(None).cast("bigint") for c in ("source_position", "position")})

    def _sizes(self) -> list[int]:
        if not hasattr(self, "_all_sizes"):
            found = {r["file"]: r["rows"] for r in self.spark.read.parquet(f"{self.path}/_keys").select("file", "rows").collect()} if self.files else {}
            self._all_sizes = [found[f] for f in self.files]
        return self._all_sizes

    def files_of(self, first: int, n: int) -> list[str]:
        """The files that hold the view's positions first to first + n - 1."""
        first, last = max(first, 0), min(first + n, self.size) - 1
        if last < first:
            return []
        if self.descending:
            first, last = self.size - 1 - last, self.size - 1 - first
        a, b = bisect_left(self.ends, first + 1), bisect_left(self.ends, last + 1)
        return [f for f, c in zip(self.files[a : b + 1], self.counts[a : b + 1], strict=True) if c]

    def page(self, first: int, n: int) -> DataFrame:
        """The rows at positions first to first + n - 1 of the view, with position and source_position; fewer at its end."""
        files = self.files_of(first, n)
        rows = self._numbered(files) if files else self._none()
        return rows.where((F.col("position") >= first) & (F.col("position") < first + n))

    def positions(self, wanted: DataFrame) -> DataFrame:
        """position (in the view) and source_position of the rows (the first columns of the order) that are wanted; none for rows outside it."""
        placed = materialise(self.keyed._placed(wanted.distinct(), wanted.columns, wanted.columns))
        files = sorted(r["file_"] for r in placed.select("file_").distinct().collect())  # at most the report's files
        rows = self._numbered(files) if files else self._none()
        asked = wanted.distinct().toDF(*(f"w_{c}" for c in wanted.columns))
        on: Column = F.lit(True)
        for c in wanted.columns:
            on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        return rows.join(asked, on, "left_semi").select(*wanted.columns, "position", "source_position")
