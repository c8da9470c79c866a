"""Regular-expression matches with positions, in built-in functions only.

The gaps between matches come from ``split`` with the same pattern, so the
start of match i is the length of gaps 0..i and matches 0..i-1; the running
totals take work in proportion to the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.arrays import let, running_sum

MATCHES = "array<struct<start:int,end:int,from:int,to:int,m:string>>"


def matches(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, from, to int, m string>> of the leftmost non-overlapping matches; start and end in code points, from and to in bytes of UTF-8.

    The pattern must not match the empty string nor look beyond its match (the
    gaps are cut by the same pattern). No match and a null text: empty array.
    """
    pair = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))

    def walk(p: Column) -> Column:
        # code points in the upper half, bytes (below 2**31 in a text) in the lower one
        size = lambda x: F.shiftleft(F.length(x).cast("bigint"), 32) + F.octet_length(x)
        ends = running_sum(F.transform(p["m"], lambda m, i: size(F.get(p["g"], i)) + size(m)))

        def one(m: Column, e: Column) -> Column:
            end, to = F.shiftright(e, 32).cast("int"), e.bitwiseAND((1 << 32) - 1).cast("int")
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), (to - F.octet_length(m)).alias("from"), to.alias("to"), m.alias("m"))

        return F.zip_with(p["m"], ends, one)

    return F.when(F.rlike(text, pattern), let(pair, walk)).otherwise(F.array().cast(MATCHES))


__all__ = ["MATCHES", "let", "matches"]
