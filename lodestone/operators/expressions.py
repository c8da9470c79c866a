"""What each part of an expression tree is used for, and the references that its leaves make.

A part's use is five bits that come down from the whole (``classify``). Every
step is a function of the bits above that distributes over OR, so it is
known by what it makes of no bit and of each bit alone: six values of five bits,
packed into one number. Functions compose the same way, which lets
``pointers.followed`` take a tree of any depth in a logarithm of rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import classify
from lodestone.operators.pointers import LEAST, followed

WIDTH = 5
INPUTS = (0, *(1 << i for i in range(WIDTH)))


def part_flags(expression: Column, part: Column, flags: Column) -> Column:
    """Use of a part of an expression whose own use is flags: by the rules, by the member's dot or arrow, else the whole's."""
    out = F.when(expression == "member", classify.member_base_flags(flags, part == "arrow"))
    swapped = F.when(flags.bitwiseAND(classify.CALLED) != 0, flags.bitwiseAND(~classify.CALLED).bitwiseOR(classify.READ)).otherwise(flags)
    for name, of, inherit, added in classify.EXPRESSION_RULES:
        whole = F.lit(0) if not inherit else swapped if name.endswith("assign") else flags
        out = out.when((expression == name) & (part == of), whole.bitwiseOR(added))
    return out.otherwise(flags)


def node_flags(flags: Column, is_expression: Column, is_rvalue: Column) -> Column:
    """A node's use of what came down to it: an rvalue's keeps less, a statement has none."""
    return F.when(~is_expression, F.lit(0)).when(is_rvalue, classify.rvalue_flags(flags)).otherwise(flags)


def packed(step: Callable[[Column], Column]) -> Column:
    """A step as one number."""
    out = F.lit(0).cast("bigint")
    for i, bits in enumerate(INPUTS):
        out = out.bitwiseOR(F.shiftleft(step(F.lit(bits)).cast("bigint"), WIDTH * i))
    return out


def applied(step: Column, flags: Column) -> Column:
    """What a packed step makes of flags."""
    field = lambda i: F.shiftright(step, WIDTH * i).bitwiseAND((1 << WIDTH) - 1)
    out = field(0)
    for i in range(WIDTH):
        out = out.bitwiseOR(F.when(flags.bitwiseAND(1 << i) != 0, field(i + 1)).otherwise(F.lit(0)))
    return out


def composed(near: Column, far: Column) -> Column:
    """The packed step far, then near; a null far leaves near."""
    return F.when(far.isNull(), near).otherwise(packed(lambda bits: applied(near, applied(far, bits))))


def context_flags(nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """nodes with flags: the use of each.

    nodes: node, parent (null for a root, which is used for nothing), expression
    and part (what the parent is, and which part of it the node), is_expression,
    is_rvalue. A null or unknown expression hands the whole's use on; null
    is_expression counts as true, null is_rvalue as false. Nodes are unique.
    """
    c = F.col
    own = packed(lambda bits: node_flags(part_flags(F.coalesce(c("expression"), F.lit("")), F.coalesce(c("part"), F.lit("")), bits), F.coalesce(c("is_expression"), F.lit(True)), F.coalesce(c("is_rvalue"), F.lit(False))))
    steps = nodes.select("node", "parent", own.alias("step"))
    # a step that ignores what is above it ends the chain
    same = F.lit(True)
    for i in range(1, WIDTH + 1):
        same = same & (F.shiftright("step", WIDTH * i).bitwiseAND((1 << WIDTH) - 1) == c("step").bitwiseAND((1 << WIDTH) - 1))
    found = followed(steps.withColumn("parent", F.when(~same, c("parent"))), "node", "parent", {"step": composed}, least)
    return nodes.join(found.select("node", applied(c("step"), F.lit(0)).cast("int").alias("flags")), "node")


def leaf_references(nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """node, flags, kind: the references that the nodes with is_function (null: the node names no declaration) make."""
    used = context_flags(nodes, least).where("is_function IS NOT NULL")
    return used.select("node", "flags", F.explode(classify.reference_kinds(F.col("flags"), F.col("is_function"), F.coalesce("is_rvalue", F.lit(False)))).alias("kind"))
