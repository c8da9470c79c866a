"""Values along chains of pointers, by doubling: a chain of any depth takes the logarithm of it in rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.store import materialise

#: A pointer is followed by a broadcast where more than a HOT-th of all rows, and LEAST at least, point to its target; so there are under HOT of these.
HOT, LEAST = 1000, 10_000
ROUNDS = 48


def looked_up(rows: DataFrame, targets: DataFrame, key: str, n: int, least: int = LEAST) -> DataFrame:
    """n rows, left-joined to targets of one row per key; targets that a large part of the rows name don't send those rows to one task."""
    if n <= least:
        return rows.join(targets, key, "left")
    heavy = materialise(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, n // HOT)).select(key))
    few = F.broadcast(heavy)  # under HOT rows
    rest = rows.join(few, key, "left_anti").join(targets, key, "left")
    return rest.unionByName(rows.join(few, key, "left_semi").join(F.broadcast(targets.join(few, key, "left_semi")), key, "left"))


def followed(rows: DataFrame, key: str, up: str, merge: dict[str, Callable[[Column, Column], Column]], least: int = LEAST) -> DataFrame:
    """key and the merged values of each row and all that its chain of pointers (up, null at the end) leads to.

    merge: for each value column, what a row's value and the value of the rows
    further up make; it must be associative and take null for "nothing above".
    A pointer to a missing key ends the chain. Rows whose chain has ended are
    not touched again. Runs an action per round; raises where pointers go round.
    """
    state = materialise(rows.select(key, up, *merge))
    done, active = state.where(F.col(up).isNull()), state.where(F.col(up).isNotNull())
    for _ in range(ROUNDS):
        n = active.count()
        if not n:
            return done.select(key, *merge)
        ahead = done.unionByName(active).select(F.col(key).alias(up), F.col(up).alias("_next"), *(F.col(c).alias(f"_far_{c}") for c in merge))
        merged = looked_up(active, ahead, up, n, least).select(key, F.col("_next").alias(up), *(f(F.col(c), F.col(f"_far_{c}")).alias(c) for c, f in merge.items()))
        merged = materialise(merged)
        done, active = done.unionByName(merged.where(F.col(up).isNull())), merged.where(F.col(up).isNotNull())
    raise ValueError(f"pointers of {up} go round")
