"""Parquet datasets in the order of their keys, with the first and last key of every file beside them.

A lookup finds the files that can hold its keys by a binary search over that
list (an as-of join of keys with first keys) and reads those files only; row
groups inside them are skipped by their statistics.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.sources.store import materialise, write_clustered

#: Folder of the list of files; readers of the dataset skip it by its name.
FILES = "_keys"


def write_keyed(df: DataFrame, path: str, keys: list[str], partitions: int | None = None, compression: str = "snappy") -> None:
    """Write df in the order of keys, and the list of its files: file, rows, first, last (structs of the keys)."""
    write_clustered(df, path, keys, partitions, compression)
    placed = df.sparkSession.read.schema(df.schema).parquet(path)
    key = F.struct(*keys)
    files = placed.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
    files.coalesce(1).write.parquet(f"{path}/{FILES}")  # a row per file of the dataset


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{FILES}")


def _sortable(row: tuple) -> tuple:
    """A key that compares as Spark orders it: null before all values."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


class Keyed:
    """A dataset that write_keyed made; keys are its leading columns."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        listed = files_of(spark, path).orderBy("first").collect()  # a row per file: bounded by the dataset's files, not its rows
        self.files = [r["file"] for r in listed]
        self.keys = listed[0]["first"].__fields__ if listed else []
        self.first, self.last = ([_sortable(tuple(r[c])) for r in listed] for c in ("first", "last"))
        self.schema = spark.read.parquet(path).schema

    def rows(self, files: list[str]) -> DataFrame:
        """The rows of some files only."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))

    def _placed(self, wanted: DataFrame, low: list[str], high: list[str], only_first: bool = False) -> DataFrame:
        """wanted with file: each file that can hold a key between its low and high prefix (columns); only_first: the one with the first key at or after low."""
        files, m = self.files, len(low)
        ends, starts = [k[:m] for k in self.last], [k[: len(high)] for k in self.first]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = {c: b.column(c).to_pylist() for c in {*low, *high}}
                at, found = [], []
                for i in range(b.num_rows):
                    begin = bisect_left(ends, _sortable(tuple(cols[c][i] for c in low)))
                    end = begin + 1 if only_first else bisect_right(starts, _sortable(tuple(cols[c][i] for c in high)))
                    for f in files[begin:end]:
                        at.append(i)
                        found.append(f)
                yield b.take(pa.array(at, pa.int64())).append_column("file_", pa.array(found, pa.string()))

        return wanted.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in wanted.schema)}, file_ string")

    def _read(self, placed: DataFrame) -> DataFrame:
        """Rows of the files that placed (materialised) names."""
        names = sorted(r["file_"] for r in placed.select("file_").distinct().collect())  # at most the dataset's files
        return self.rows(names)

    def lookup(self, wanted: DataFrame, upto: str | None = None) -> DataFrame:
        """The rows that have a wanted prefix: wanted's columns are the first keys, in any number.

        upto: a column of wanted; the last of the key columns may then have any
        value from its own to that of upto. Each row comes once. Nulls are equal.
        """
        own = [c for c in wanted.columns if c != upto]
        if own != self.keys[: len(own)]:
            raise ValueError(f"{own} are not the first of {self.keys}")
        wanted = wanted.distinct()
        placed = materialise(self._placed(wanted, own, own[:-1] + [upto] if upto else own))
        rows = self._read(placed)
        asked = placed.drop("file_").distinct().toDF(*(f"w_{c}" for c in placed.columns[:-1]))
        on: Column = F.lit(True)
        for c in own[:-1] if upto else own:
            on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        if upto:
            on = on & F.col(own[-1]).between(F.col(f"w_{own[-1]}"), F.col(f"w_{upto}"))
        return rows.join(asked, on, "left_semi")

    def lower_bounds(self, wanted: DataFrame) -> DataFrame:
        """wanted (a prefix of the keys) with found: the first row at or after it as a struct, null where there is none.

        Rows and keys of a file are put in one order, and each key takes the
        next row: an as-of join in each file, whose size bounds the window.
        """
        own = wanted.columns
        if own != self.keys[: len(own)]:
            raise ValueError(f"{own} are not the first of {self.keys}")
        wanted = wanted.distinct()
        placed = materialise(self._placed(wanted, own, own, only_first=True))
        rows = self._read(placed)
        rows = rows.select(F.col("_metadata.file_name").alias("file_"), F.struct(*(F.col(c) for c in own)).alias("k"), F.lit(1).alias("is_row"), F.struct(*rows.columns).alias("found"))
        asked = placed.select("file_", F.struct(*own).alias("k"), F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["found"].dataType).alias("found"))
        # in falling order the last row seen is the next one of the rising order; of equal prefixes the least row is seen last
        order = W.partitionBy("file_").orderBy(F.desc("k"), F.desc("is_row"), F.desc_nulls_last("found")).rowsBetween(W.unboundedPreceding, W.currentRow)
        got = rows.unionByName(asked).withColumn("found", F.last("found", ignorenulls=True).over(order)).where("is_row = 0").select("k.*", "found")
        on: Column = F.lit(True)
        for c in own:
            on = on & F.col(f"w_{c}").eqNullSafe(F.col(c))
        return wanted.toDF(*(f"w_{c}" for c in own)).join(got, on, "left").select(*(F.col(f"w_{c}").alias(c) for c in own), "found")
