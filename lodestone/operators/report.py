"""Tabular reports: columns, sorting, filtering, widths and slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import report_filter
from lodestone.operators.dictionary import ranked


@dataclass(frozen=True)
class Report:
    """rows holds the shown columns and source_row, the order in which equal rows stand.

    closes: whether activating a row closes the report's window (None: no rule).
    """

    title: str
    columns: tuple[str, ...]
    rows: DataFrame
    closes: bool | None = None

    def filter(self, pattern: str) -> Report:
        """Only rows whose first column matches."""
        return Report(self.title, self.columns, self.rows.where(report_filter(F.col(self.columns[0]), pattern)), self.closes)

    def sorted(self, column: str, descending: bool = False, name: str = "position") -> DataFrame:
        """rows with their 0-based position; descending is the exact reverse, ties included. Missing values come first (last in reverse)."""
        key: list[Column] = [F.col(column).desc_nulls_last(), F.desc("source_row")] if descending else [F.col(column).asc_nulls_first(), F.asc("source_row")]
        return ranked(self.rows, key, name)

    def widths(self) -> DataFrame:
        """Longest text of each column, its title included."""
        width = lambda c: F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c)))
        return self.rows.agg(*[width(c).cast("bigint").alias(c) for c in self.columns])

    def page(self, column: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
        """The rows at positions offset to offset + limit - 1."""
        at = F.col("position")
        return self.sorted(column, descending).where((at >= offset) & (at < offset + limit))


def numbered(df: DataFrame, order: list[str], name: str = "source_row") -> DataFrame:
    return ranked(df, order, name)


def reference_report(refs: DataFrame, symbol: str) -> Report:
    rows = numbered(refs.where(F.col("symbol") == symbol).distinct(), ["file", "line", "start_col", "end_col", "kind"])
    return Report(f"References to {symbol}", ("file", "line", "kind"), rows)


def definition_report(definitions: DataFrame) -> Report:
    rows = numbered(definitions, ["symbol", "file", "line", "start_col", "end_col"])
    return Report("Global Definitions", ("symbol", "file"), rows, closes=True)


def file_report(paths: DataFrame) -> Report:
    return Report("Files", ("path",), numbered(paths, ["path"]), closes=True)


def symbol_report(types: DataFrame) -> Report:
    return Report("Symbols", ("symbol", "symbol_type"), numbered(types, ["symbol"]), closes=False)


def batches(report_rows: DataFrame, n: int) -> DataFrame:
    """report_rows (source_row) with batch: groups of a twentieth of the n rows, 100 at least."""
    return report_rows.withColumn("batch", F.floor(F.col("source_row") / F.lit(max(100, n // 20))).cast("bigint"))
