"""Runs of the strongest span against a plain array of places."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.sweep import swept, top_runs

SPANS = "file string, start bigint, end bigint, rank bigint, value string"


def plain(rows):
    """(file, start, end, value) of maximal runs."""
    out = []
    for file in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == file and r[2] > r[1] and r[4] is not None and r[3] is not None]
        cells = {}
        for _, a, b, rank, value in own:
            for i in range(a, b):
                cells[i] = max(cells.get(i, (rank, value)), (rank, value))
        at = None
        for i in sorted(cells):
            v = cells[i][1]
            if at and at[2] == i and at[3] == v:
                at[2] = i + 1
            else:
                at = [file, i, i + 1, v]
                out.append(at)
    return sorted((str(f), a, b, v) for f, a, b, v in out)


def got(spark, rows, stretch):
    return sorted((str(r.file), r.start, r.end, r.value) for r in top_runs(spark.createDataFrame(rows, SPANS).repartition(3), ["file"], stretch).collect())


@pytest.mark.parametrize(("stretch", "seed"), [(4, 0), (4, 1), (16, 2), (4096, 3)])
def test_runs(spark, stretch, seed):
    rng = random.Random(seed)
    rows = []
    for f in ("a", "b", None):
        for _ in range(60):
            a = rng.randrange(0, 400)
            rows.append((f, a, a + rng.choice([0, 1, 3, 4, 8, 40, 200]), rng.randrange(9), rng.choice(["x", "y", "z"])))
    rows += [("a", 0, 600, -1, "ground"), ("a", 16, 64, 5, "x"), ("a", 64, 128, 5, "x"), ("b", 5, 5, 9, "none"), ("b", 9, 3, 9, "none"), ("b", 3, 9, None, "none"), ("b", 3, 9, 99, None), *[("c", 8, 12, 1, "same")] * 5]
    assert got(spark, rows, stretch) == plain(rows)


def test_long_spans_cost_little(spark):
    """A span of 10^12 places under a few short ones."""
    n = 10**12
    rows = [("a", 0, n, 0, "ground"), ("a", 10, 20, 1, "x"), ("a", n // 2, n // 2 + 5000, 1, "y"), ("a", n - 7, n + 3, 2, "z"), ("b", 4096, 8192, 0, "w"), ("b", 8192, 3 * 4096, 0, "w")]
    assert got(spark, rows, 4096) == [("a", 0, 10, "ground"), ("a", 10, 20, "x"), ("a", 20, n // 2, "ground"), ("a", n // 2, n // 2 + 5000, "y"), ("a", n // 2 + 5000, n - 7, "ground"), ("a", n - 7, n + 3, "z"), ("b", 4096, 12288, "w")]


def test_no_spans(spark):
    assert got(spark, [], 8) == [] and got(spark, [("a", 3, 3, 1, "x")], 8) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 5)), max_size=20))
def test_swept(spans):
    parts = sorted((a, a + n, rank, f"v{rank}") for a, n, rank in spans)
    assert [(str(None), *r) for r in swept(parts)] == plain([(None, *p) for p in parts])
