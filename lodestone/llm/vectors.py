"""Vectors as integers, and sums by position, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components are exact integers of a double up to here.
LIMIT = 1 << 53


def integers(df: DataFrame, scale: int, add: int = 0) -> DataFrame:
    """vec_id long, label string, x array<long> = floor(scale * component) + add, of the rows that take part.

    Rows whose vector is null, empty or holds a null or non-finite component
    take none, nor do those of another length than the vector of the smallest
    id (of several the smallest vector).
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    label = F.col("label").cast("string") if "label" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    beyond = F.raise_error(F.lit(f"a component times {scale} is beyond 2^53"))
    x = F.transform("v", lambda c: F.when(F.abs(c) * scale < LIMIT, F.floor(c * scale) + add).otherwise(beyond.cast("long")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    return rows.where(F.size("v") == (first[0]["n"] if first else 0)).select("vec_id", "label", x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch of arrays of d numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def added(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, v: sums by position of the arrays v (of at most width numbers) of the rows of each key; integers stay exact."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(width))).alias("v"))
