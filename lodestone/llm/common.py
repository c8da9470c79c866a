"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.sources.store import materialise as written
from lodestone.sources.store import shared_dir, table

#: A word is a maximal run of anything but the ASCII white space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text as an array; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: each word ends at white space or at the end."""
    blanked = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    gaps = F.length(blanked) - F.length(F.replace(blanked, F.lit(" "), F.lit("")))
    return F.when(blanked == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def bucket_bits(n: int, rows: int = 512) -> int:
    """Bits of a hash that tell buckets of about so many rows apart."""
    return max(0, (n // rows).bit_length())


def running_total(rows: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """rows with the sum of value over earlier rows of its keys and itself, in the order (bucket, order).

    bucket must split large groups into parts of bounded size and must be a
    function of the leading order column that never falls.
    """
    cut = rows.withColumn("_b", bucket).withColumn("_v", value)
    sums = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum("_v").over(W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("_in", inside).join(offsets, [*keys, "_b"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_b", "_v")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], row: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined to a right side of one row per key, which is copied salts times, so that a hot key of left is dealt over as many tasks."""
    own = left.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    return own.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how).drop("_salt")


BLOCK = "part int, task int, sums binary"
PARTS = 64


def blocks_of(vector: np.ndarray) -> pa.RecordBatch:
    """A task's vector of 64-bit floats as PARTS rows of BLOCK."""
    cuts = [x.astype("<f8").tobytes() for x in np.array_split(vector, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId() % PARTS] * PARTS, pa.int32()), pa.array(cuts, pa.binary())], ["part", "task", "sums"])


def vector_sum(blocks: DataFrame) -> np.ndarray:
    """The sum of all tasks' vectors (rows of BLOCK); its length, not the number of tasks, bounds what the driver gets.

    Two rounds: PARTS groups of tasks first, then the groups, so no task reads what all tasks wrote.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for part, task, sums in zip(*(b.column(c).to_pylist() for c in ("part", "task", "sums")), strict=True):
                own = np.frombuffer(sums, "<f8")
                total[part, task] = total[part, task] + own if (part, task) in total else own
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["part", "task", "sums"])

    first = blocks.repartition(4 * PARTS, "part", "task").mapInArrow(add, BLOCK)
    got = first.withColumn("task", F.lit(0)).repartition(PARTS, "part").mapInArrow(add, BLOCK).collect()
    return np.concatenate([np.frombuffer(r["sums"], "<f8") for r in sorted(got, key=lambda r: r["part"])])


__all__ = ["BLOCK", "SPACE", "WORD", "blocks_of", "bucket_bits", "running_total", "shared_dir", "spread_join", "table", "vector_sum", "word_array", "word_count", "written"]
