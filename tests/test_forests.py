"""Uses down expression trees and names of declaration forests, against plain recursion."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import classify, expressions, naming, pointers

NODES = "node long, parent long, expression string, part string, is_expression boolean, is_rvalue boolean, is_function boolean"
RULES = {(e, p): (inherit, added) for e, p, inherit, added in classify.EXPRESSION_RULES}


def down(expression, part, flags):
    if expression == "member":
        return 2 if part == "arrow" else (flags & 4) | (16 if flags & 24 else 0) | (2 if flags & 3 else 0)
    if (expression, part) not in RULES:
        return flags
    inherit, added = RULES[expression, part]
    if expression in ("assign", "compound-assign") and flags & 1:
        flags = flags & ~1 | 2
    return (flags if inherit else 0) | added


def plain_flags(rows):
    of = {r[0]: r for r in rows}
    known = {}
    for start in of:
        chain = []
        while start in of and start not in known:
            chain.append(start)
            start = of[start][1]
        for n in reversed(chain):
            _, parent, expression, part, is_expression, is_rvalue, _ = of[n]
            f = down(expression, part, known.get(parent, 0))
            known[n] = 0 if is_expression is False else f & 3 if is_rvalue else f
    return known


def trees(n, seed, chain=0, star=0):
    rng = random.Random(seed)
    roles = [*RULES, ("member", "dot"), ("member", "arrow"), ("parenthesis", "operand"), (None, None), ("other", None)]
    rows = []
    for i in range(n):
        parent = None if i % 50 == 0 else i - 1 if i < chain else 0 if rng.random() < star else rng.randrange(max(0, i - 4), i)
        e, p = ("parenthesis", "operand") if i < chain else rng.choice(roles)
        rows.append((i, parent if i >= chain or i == 0 else i - 1, e, p, rng.choice([True, True, True, None, False]) if i >= chain else True, rng.choice([True, False, None]) if i >= chain else None, rng.choice([True, False, None])))
    return rows


@pytest.mark.parametrize(("n", "chain", "star", "least"), [(300, 0, 0, 10_000), (900, 600, 0.5, 20)])
def test_flags(spark, n, chain, star, least):
    rows = trees(n, 1, chain, star)
    if chain:
        rows[0] = (0, None, "assign", "left", True, None, None)
    rows.append((5000, 77777, "call", "callee", True, False, True))  # its parent is missing
    got = {r.node: r.flags for r in expressions.context_flags(spark.createDataFrame(rows, NODES).repartition(7), least).collect()}
    assert got == plain_flags(rows)
    if chain:
        assert got[chain - 1] == 8


def test_references_of_trees(spark):
    rows = [(1, None, "assign", "left", True, False, False), (2, 1, "member", "dot", True, False, False), (3, 2, "parenthesis", "operand", True, True, False), (4, None, "call", "callee", True, None, True), (5, None, None, None, None, None, False), (6, 4, "call", "argument", True, False, None)]
    got = sorted((r.node, r.flags, r.kind) for r in expressions.leaf_references(spark.createDataFrame(rows, NODES)).collect())
    assert got == [(1, 8, "Assigned"), (2, 16, "Modified"), (3, 0, "Read"), (4, 1, "Called"), (5, 0, "Other")]
    assert expressions.leaf_references(spark.createDataFrame([], NODES)).count() == 0


def test_rules_distribute_over_or(spark):
    """A step is known by what it makes of no bit and of each bit."""
    roles = [*RULES, ("member", "dot"), ("member", "arrow"), ("x", "y")]
    for e, p in roles:
        for f in range(32):
            alone = down(e, p, 0)
            for i in range(5):
                if f >> i & 1:
                    alone |= down(e, p, 1 << i)
            assert alone == down(e, p, f)
    rows = spark.createDataFrame([(e, p, f) for e, p in roles for f in range(32)], "e string, p string, f int")
    step = expressions.packed(lambda x: expressions.part_flags(F.col("e"), F.col("p"), x))
    for r in rows.select("*", expressions.part_flags(F.col("e"), F.col("p"), F.col("f")).alias("direct"), expressions.applied(step, F.col("f")).alias("by_step")).collect():
        assert r.direct == r.by_step == down(r.e, r.p, r.f)


def test_pointers_that_go_round(spark, monkeypatch):
    monkeypatch.setattr(pointers, "ROUNDS", 3)
    with pytest.raises(ValueError, match="go round"):
        pointers.followed(spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "k long, up long, v long"), "k", "up", {"v": lambda a, b: a})


def test_hot_pointers(spark):
    rows = spark.range(1, 3001).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("up"), F.lit(1).alias("v"))
    got = {r.k: r.v for r in pointers.followed(rows, "k", "up", {"v": lambda a, b: a + F.coalesce(b, F.lit(0))}, least=50).collect()}
    depth = {}
    for k in range(1, 3001):
        depth[k] = 1 + depth[1 if k % 3 == 0 else k // 2] if k > 1 else 1
    assert got == depth


# --- names ----------------------------------------------------------------

COLUMNS = [c.split()[0] for c in naming.DECLARATIONS.split(", ")]


def plain_names(rows):
    """Each name by walking out from its declaration."""
    of = {r["decl"]: r for r in rows}

    def special(r):
        while not r["explicit"]:
            r = of.get(r["origin"])
            if r is None or r["class"] != "class-specialisation":
                return None
        return r["arguments"] or []

    def visit(r, inside, asks):
        """Path of r; asks collects what it needs before it."""
        kind, first = r["class"], of.get(r["canonical"])
        first_c = bool(first["extern_c"] if first and first["extern_c"] is not None else r["extern_c"])
        if kind == "function":
            if inside and (of[r["origin"]] if r["origin"] in of and of[r["origin"]]["class"] == "function" else r)["defining"]:
                asks.update(("file", "offset"))
            if r["origin"] in of and of[r["origin"]]["class"] == "function":
                r = of[r["origin"]]
            if not first_c and not r["external"]:
                asks.add("file")
        if kind == "namespace" and r["name"] is None or kind == "variable" and not r["extern_c"] and not r["external"]:
            asks.add("file")
        outer = of.get(r["parent"])
        path = visit(outer, True, asks) if outer and outer["class"] != "linkage" else []
        tag = r["typedef_name"] or r["name"] or f"<unnamed{r['offset']}>"
        if kind == "enum" and inside:
            return path
        if kind == "namespace":
            own = r["name"] or "<anon>"
        elif kind in ("tag", "enum"):
            own = tag
        elif kind == "class-specialisation":
            args = special(r)
            own = tag + ("" if args is None else f"<{', '.join(args)}>")
        elif kind == "function":
            own = (r["name"] or "") + (f"<{', '.join(r['arguments'])}>" if r["arguments"] is not None else "") + ("" if first_c else f"({', '.join(r['parameters'] or [])}){r['qualifiers'] or ''}")
        else:
            own = r["name"]
        return path if own is None else [*path, own]

    out = {}
    for r in rows:
        if r["class"] == "linkage" or r["name"] is None and r["class"] not in ("namespace", "tag", "enum", "function", "class-specialisation"):
            continue
        asks = set()
        path = visit(r, False, asks)
        place = of.get(r["canonical"], r)
        before = "" if not asks or place["file"] is None else place["file"].rsplit("/", 1)[-1] + (f"@{place['offset']}" if "offset" in asks else "") + "/"
        out[r["decl"]] = before + "::".join(path)
    return out


def decl(i, parent, kind, name=None, **more):
    base = dict.fromkeys(COLUMNS) | {"decl": i, "parent": parent, "class": kind, "name": name, "file": "/s/a.cc", "offset": i * 10, "extern_c": False, "external": False}
    return base | more


def names_of(spark, rows, least=10_000):
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], naming.DECLARATIONS)
    return {r.decl: r.symbol for r in naming.symbol_names(df, least).collect()}


def test_names_by_hand(spark):
    rows = [
        decl(1, None, "namespace", "std"), decl(2, 1, "class-specialisation", "vector", explicit=False, origin=3), decl(3, 1, "class-specialisation", "vector", explicit=True, arguments=["bool", "A"]), decl(4, 2, "function", "size", parameters=[], qualifiers=" const", external=True),
        decl(5, None, "namespace"), decl(6, 5, "function", "helper", parameters=["int", "char *"]), decl(7, 6, "variable", "local", canonical=6), decl(8, None, "function", "main", extern_c=True, parameters=["int"], defining=True),
        decl(9, 8, "variable", "x"), decl(10, None, "enum", "Colour"), decl(11, 10, "enumerator", "red"), decl(12, None, "tag", typedef_name="S"), decl(13, 12, "field", "f"), decl(14, None, "tag"), decl(15, 1, "linkage"), decl(16, 15, "function", "c", external=True, parameters=[]),
        decl(17, None, "class-specialisation", "plain", explicit=False), decl(18, None, "function", "inst", origin=4, parameters=["no"], extern_c=False, canonical=8), decl(19, 1, "field"), decl(20, 99, "tag", "lost"), decl(21, None, "variable", "v", file=None),
    ]
    got = names_of(spark, rows)
    assert got == plain_names(rows)
    assert got[4] == "std::vector<bool, A>::size() const" and got[7] == "a.cc/<anon>::helper(int, char *)::local" and got[9] == "a.cc@90/main::x" and got[11] == "red" and got[13] == "S::f" and got[14] == "<unnamed140>"
    assert got[16] == "c()" and got[17] == "plain" and got[18] == "std::vector<bool, A>::size" and 15 not in got and 19 not in got and got[20] == "lost" and got[21] == "v"


@pytest.mark.parametrize("least", [30, 10_000])
def test_names_of_forests(spark, least):
    rng = random.Random(4)
    kinds = ["namespace", "namespace", "tag", "enum", "function", "variable", "class-specialisation", "enumerator", "linkage"]
    rows = []
    for i in range(400):
        kind = rng.choice(kinds)
        near = lambda: rng.choice([None, *range(max(0, i - 40), i), 9999])  # noqa: B023, E731
        rows.append(
            decl(
                i, 0 if rng.random() < 0.3 and i else near() if i % 40 else None, kind, rng.choice([None, "a", "b"]) if kind != "function" else "f", typedef_name=rng.choice([None, "T"]), file=rng.choice([None, "/x/y.h", "z.c"]), canonical=rng.choice([None, i, near()]),
                extern_c=rng.choice([None, True, False]), external=rng.choice([None, True, False]), defining=rng.choice([None, True, False]), explicit=rng.choice([True, False, False]), origin=near(), arguments=rng.choice([None, ["int"], ["A", "B"]]), parameters=rng.choice([None, [], ["int", "T"]]), qualifiers=rng.choice([None, " const"]),
            )
        )
    assert names_of(spark, rows, least) == plain_names(rows)


def test_names_of_nothing(spark):
    assert names_of(spark, []) == {}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**30 - 1), st.integers(0, 31))
def test_application_keeps_bits(step, flags):
    want = step & 31
    for i in range(5):
        if flags >> i & 1:
            want |= step >> 5 * (i + 1) & 31
    assert want < 32
