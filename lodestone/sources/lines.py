"""Lines of files of any size, as they lie in a folder.

Spark's text reader gives each split of a file its rows, cut at line feeds only.
A split's rows are numbered where they are read; only one row for each split
(its numbers of lines and bytes) is added up along a file, so no file is in one
task and no text is shuffled. Splits come from spark.sql.files.maxPartitionBytes.
A single row (between two line feeds) must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OUT = 4096


def _rows(spark: SparkSession, path: str) -> DataFrame:
    where = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(where["file_path"].alias("file"), where["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


class _Piece:
    """Lines of one split in order: a carriage return ends a line, with or without the line feed after it; a NUL ends the file."""

    def __init__(self) -> None:
        self.lines = self.bytes = 0
        self.closed = False

    def take(self, row: bytes) -> list[bytes]:
        if self.closed:
            return []
        nul = row.find(b"\0")
        if nul >= 0:
            self.closed, row = True, row[:nul]
            if not row:
                return []  # the line feed before it was the file's last
        return row.removesuffix(b"\r").split(b"\r")

    def count(self, texts: list[bytes]) -> None:
        self.lines += len(texts)
        self.bytes += sum(map(len, texts)) + len(texts)


def _pieces(rows: DataFrame) -> DataFrame:
    """file, block, lines, bytes, closed of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece = None, _Piece()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, piece.lines, piece.bytes, piece.closed), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["file", "block", "lines", "bytes", "closed"])

        for b in batches:
            for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != at:
                    if at:
                        yield out()
                    at, piece = (file, block), _Piece()
                piece.count(piece.take(value))
        if at:
            yield out()

    return rows.mapInArrow(run, "file string, block long, lines long, bytes long, closed boolean")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), start, len (bytes), text of every line of the files at path.

    Carriage returns, with or without a line feed, are line feeds; a file ends at
    its first NUL; what follows its last line feed is a line only if it has text;
    an empty file has none. Offsets count the text so normalised.
    """
    rows = _rows(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, held = None, _Piece(), []

        def out() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], ["file", "block", "line", "start", "len", "text"])
            held.clear()
            return made

        for b in batches:
            for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != at:
                    at, piece = (file, block), _Piece()
                for text in piece.take(value):
                    held.append((file, block, piece.lines, piece.bytes, len(text), text))
                    piece.count([text])
                if len(held) >= OUT:
                    yield out()
        yield out()

    own = rows.mapInArrow(run, "file string, block long, line long, start long, len long, text binary")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each split of a file
    offsets = _pieces(rows).select("file", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("lines", "bytes")), F.coalesce(F.max("closed").over(before), F.lit(False)).alias("_ended"))
    return own.join(offsets, ["file", "block"]).where("NOT _ended").select("file", (F.col("line") + F.col("_lines")).alias("line"), (F.col("start") + F.col("_bytes")).alias("start"), "len", F.col("text").cast("string").alias("text"))
