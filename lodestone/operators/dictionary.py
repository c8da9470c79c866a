"""Dictionary encoding: dense ids in byte order of the values, lookup, decoding and id maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.sources.store import materialise


def ranked(df: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """df with its 0-based position in a total order.

    Rows are range-partitioned by the order and sorted inside each partition;
    a partition's first position is the number of rows in those before it.
    Only one count per partition meets in one place. The positions are
    materialised, so a task that runs again can't renumber them.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed)
    part, pos = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row per partition
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_before") + pos).cast("bigint")).drop("_part", "_before", "_at")


def encode(values: DataFrame, column: str) -> DataFrame:
    """id, value: the distinct non-null values, numbered from 0 in byte order."""
    return ranked(values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct(), ["value"]).select("id", "value")


def lookup(dictionary: DataFrame, value: str) -> DataFrame:
    """The row of one value; none where the dictionary lacks it."""
    return dictionary.where(F.col("value") == value)


def decode(df: DataFrame, dictionary: DataFrame, column: str, out: str, missing: str | None = None) -> DataFrame:
    """df with out, the value of its id column; missing ids get missing (an inner join where it is None)."""
    d = dictionary.select(F.col("id").alias(column), F.col("value").alias(out))
    if missing is None:
        return df.join(d, column)
    return df.join(d, column, "left").withColumn(out, F.coalesce(out, F.lit(missing)))


def id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id of each value of the old dictionary."""
    return old.select(F.col("id").alias("old_id"), "value").join(new.select(F.col("id").alias("new_id"), "value"), "value").select("old_id", "new_id", "value")


def item_stats(dictionary: DataFrame) -> DataFrame:
    """Number of values and their bytes, one end byte each included."""
    return dictionary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("bigint").alias("bytes"))


def bucket_stats(dictionary: DataFrame, buckets: int) -> DataFrame:
    """Values per hash bucket."""
    return dictionary.groupBy(F.pmod(F.hash("value"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
