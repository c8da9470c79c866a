"""Array expressions whose work grows with the array, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values to a block of a running total.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each value of an array the fold by step of those up to and including it; step must be associative, with start as neutral element.

    Sums of blocks of BLOCK values are folded first, those of blocks of blocks
    before them, so no growing array is copied at each value. Arrays of up to
    BLOCK values are folded as they are.
    """
    fold = lambda xs: F.aggregate(xs, start, step)

    def level(xs: Column, k: int) -> Column:
        if not k:
            return F.aggregate(xs, F.slice(F.array(start), 1, 0), lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), start), x))))
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))

        def each(up: Column) -> Column:
            before = lambda b: F.when(b > 0, F.get(up, b - 1)).otherwise(start)
            own = lambda i, b: fold(F.slice(xs, b * BLOCK + 1, i - b * BLOCK + 1))
            return F.transform(xs, lambda _, i: let(F.floor(i / BLOCK).cast("int"), lambda b: step(before(b), own(i, b))))

        return let(blocks, lambda s: let(level(s, k - 1), each))

    return let(values, lambda xs: F.when(F.size(xs) <= BLOCK, level(xs, 0)).when(F.size(xs) > 0, level(xs, levels)).otherwise(F.slice(F.array(start), 1, 0)))


def running_sum(values: Column, levels: int = 2) -> Column:
    """Running totals of an array of integers, as array<bigint>."""
    return running(F.transform(values, lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b, levels)
