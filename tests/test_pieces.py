"""Lexing in pieces against lexing in one go."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import syntax

PARTS = ["/*", "*/", "//", "\n", "\\\n", "\\", "'", '"', "#include <a b>", "#include", "# define X", " ", "\t", "if", "word1", "1.5e+3", "<", ">", ";", ",", "{", "}", "(", "é", "#", ".", "include_next <x\n;y>", "/", "*", r"\;"]


def whole(data):
    return syntax.kinds(data)


def in_pieces(data, size):
    out, state, at = [], syntax.FRESH, 0
    for end in syntax.cuts(data, size):
        runs, state = syntax.read_piece(data[at:end], state)
        for a, b, k in runs:
            if out and out[-1][2] == k:
                out[-1] = (out[-1][0], at + b, k)
            else:
                out.append((at + a, at + b, k))
        at = end
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(1, 12))
def test_pieces_are_the_whole(text, size):
    data = text.encode()
    assert in_pieces(data, size) == whole(data)
    ends = syntax.cuts(data, size)
    assert ends[-1] == len(data) and all(a < b for a, b in zip([0, *ends], ends, strict=False) if data)


def source(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_states_go_along_a_file(spark):
    """One file in many pieces of which most hand an open comment on, small files beside it, null, empty and repeated ones."""
    files = [("big", source(4000, 1)), ("open", "/* " + "x;\n" * 500), ("quote", 'a = "' + "y, z\\\n" * 300 + '";\nif'), ("line", "// c \\\n" * 200 + "int i;"), ("one", "a;b;" * 900), ("small", "int x; // c\n#if\n"), ("null", None), ("empty", ""), *[(f"f{i}", source(300, i)) for i in range(5)]]
    df = spark.createDataFrame(files, "file string, content string").repartition(3)
    for size in (64, 1 << 18):
        got = {}
        for r in syntax.syntax_kinds(df, size).collect():
            got.setdefault(r.file, []).append((r.start, r.end, r.kind))
        assert {f: sorted(x) for f, x in got.items()} == {f: whole(c.encode()) for f, c in files if c}


def test_a_file_is_spread_over_tasks(spark):
    df = spark.createDataFrame([("big", source(20_000, 3))], "file string, content string")
    parts = syntax.pieces(df, 1000).repartition(8, "row", "n")
    assert parts.count() > 40 and parts.selectExpr("spark_partition_id() AS p").distinct().count() == 8


def test_colours_are_runs(spark):
    text = "if (x) // end\n" * 40
    spans = [("a", 0, 5, "red", 1), ("a", 3, 9, "green", 2), ("a", -4, 2, "blue", 0), ("a", 500, 9000, "blue", 3), ("a", 100, 100, "red", 4), ("a", 20, 30, None, 9), ("other", 0, 5, "red", 1)]
    df = spark.createDataFrame([("a", text), ("b", None)], "file string, content string")
    got = sorted(map(tuple, syntax.file_colours(df, spark.createDataFrame(spans, "file string, start bigint, end bigint, colour string, seq bigint"), size=50).select("start", "end", "colour").collect()))
    cells = [syntax.KIND_COLOURS.get(k, "default") for a, b, k in whole(text.encode()) for _ in range(a, b)]
    for _, a, b, colour, _ in sorted((s for s in spans if s[0] == "a" and s[3]), key=lambda s: s[4]):
        for i in range(max(a, 0), min(b, len(cells))):
            cells[i] = colour
    assert [c for a, b, c in got for _ in range(a, b)] == cells and all(x[2] != y[2] for x, y in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("content", ["", "x", "\n\n\n", "'"])
def test_small_texts(content):
    assert syntax.cuts(content.encode(), 1)[-1] == len(content)
