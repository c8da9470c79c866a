"""Work that must not grow faster than the input: tasks that take all, expressions that repeat themselves."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.arrays import running_sum
from lodestone.operators import naming, syntax, tables, text, trace, xref
from lodestone.operators.maintained import Definitions
from lodestone.plans import catalogue, indexes
from lodestone.sources import facts, store

SF = "/root/testdata/sf0.001"


def _size(spark: SparkSession, df) -> int:
    """Characters of the optimised plan."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        return len(df._jdf.queryExecution().optimizedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_trace_records_name_each_step_once(spark):
    """Lists of processes are made once, not anew for each value that is drawn from them."""
    assert _size(spark, facts.trace_records(spark, SF)) < 20_000


def test_trace_is_written_and_read_in_many_files(spark):
    """No task takes the whole trace; files keep its order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(root.glob("trace-*"))
    try:
        catalogue.QUERIES["trace_to_compile_db"](spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (made,) = set(root.glob("trace-*")) - before
    assert len(list(made.glob("trace/part-*"))) > 1
    records = facts.trace_records(spark, SF)
    want = [tuple(r) for r in records.orderBy("line").select("cwd", "pidlist", "argv").collect()]
    assert [tuple(r) for r in trace.read_trace(spark, f"{made}/trace").orderBy("line").select("cwd", "pidlist", "argv").collect()] == want


def test_running_sums_of_short_and_long_arrays(spark):
    rows = spark.range(1).select(*(running_sum(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x)).alias(f"n{n}") for n in (1, 31, 32, 33, 1025))).collect()[0]
    for n in (1, 31, 32, 33, 1025):
        assert rows[f"n{n}"] == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_lines_words_and_widths_fold_no_arrays(spark):
    """Starts and widths are summed in batches, not by folds over arrays; values as before."""
    files = spark.createDataFrame([("a", "x\u00e9 \U0001f600y\n\n z"), ("b", ""), ("c", None), (None, "\n"), ("d", "w\n")], "file string, content string")
    rows = text.lines(files)
    got = sorted(map(tuple, rows.collect()), key=str)
    assert got == sorted([("a", 0, 0, 9, "x\u00e9 \U0001f600y"), ("a", 1, 10, 0, ""), ("a", 2, 11, 2, " z"), (None, 0, 0, 0, ""), ("d", 0, 0, 1, "w")], key=str)
    widths = text.char_widths(rows)
    assert sorted(tuple(r)[2:] for r in widths.where("file = 'a' AND line = 0").collect()) == [(0, 1, True), (1, 2, False), (3, 1, False), (4, 4, False), (8, 1, True)]
    places = spark.createDataFrame([("a", 0, c) for c in range(10)], "file string, line bigint, col bigint")
    words = text.words_at(rows, places)
    assert [r["word"] for r in words.orderBy("col").collect()] == ["x", "\u00e9", "\u00e9", " ", *["\U0001f600"] * 4, "y"]
    for df in (rows, widths, words):
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_hold_a_part_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000, None] * 3000 + ["y" * (3 * text.PART)])], ["content"])
    parts = list(text._parts(batch, "content"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) <= 2 * text.PART // 1000 + 2 and len(parts) > 3
    assert not list(text._parts(batch.slice(0, 0), "content"))


def test_plain_text_is_no_sequence_of_tokens(monkeypatch):
    taken = []

    class Counted:
        def match(self, data, at):
            taken.append(at)
            return token.match(data, at)

    token = syntax._TOKEN
    monkeypatch.setattr(syntax, "_TOKEN", Counted())
    assert syntax.kinds(b"some plain words, without a mark.\n" * 500) == [(0, 17000, "default")]
    assert len(taken) < 10


def test_files_are_listed_by_spark(spark, monkeypatch):
    """No pattern of paths: that is expanded on the driver, folder by folder."""
    seen = []
    monkeypatch.setattr(indexes, "text_files", lambda s, path: (seen.append(path), text_files(s, path))[1])
    text_files = store.text_files
    assert indexes.QUERIES["disk_files"](spark, SF).count() > 0
    assert "*" not in seen[0]


def test_maintained_steps_are_written(spark, monkeypatch):
    """Which symbols lose their least place is told by one join that is written; a task doesn't hold the sorts of all steps."""
    seen = []
    least = Definitions._least
    monkeypatch.setattr(Definitions, "_least", lambda self, symbols, *rest: seen.append(symbols._jdf.queryExecution().optimizedPlan().toString()) or least(self, symbols, *rest))
    place = lambda line, sign: ("f", line, 1, 2, "s", "Definition", None, sign)
    rows = lambda *x: spark.createDataFrame(x, "file string, line bigint, start_col bigint, end_col bigint, symbol string, kind string, symbol_type string, sign int")
    view = Definitions(spark, f"{spark.conf.get('spark.checkpoint.dir')}/steps", buckets=2)
    view.apply(rows(place(3, 1), place(5, 1)), 1)
    view.apply(rows(place(3, -1)), 2)
    assert [(r.n_def, r.line) for r in view.single().collect()] == [(1, 5)]
    view.apply(rows(place(5, -1)), 3)
    assert view.single().count() == 0
    assert len(seen) == 3 and not any("Join" in x or "Aggregate" in x for x in seen)


def test_rows_of_a_written_index_are_coded_once(spark):
    """Tables of the same rows don't repeat the joins with the dictionaries, nor does their range partitioning."""
    index = tables.build_index(facts.event_refs(spark, SF), once=True)
    plans = {n: index.table(n)._jdf.queryExecution().optimizedPlan().toString() for n in index.table_names()}
    assert {n for n, p in plans.items() if "Join" in p or "Aggregate" in p} == {"GlobalSymbol"}
    assert index.table("Reference").count() == index.table("ReferenceIndex").count() > 0


def test_segments_of_names_are_made_once(spark, monkeypatch):
    """Scopes and names are drawn from written segments, not from the joins behind them anew."""
    seen = []
    followed = naming.followed
    monkeypatch.setattr(naming, "followed", lambda rows, key, up, *rest: seen.append((up, rows._jdf.queryExecution().optimizedPlan().toString())) or followed(rows, key, up, *rest))
    assert naming.symbol_names(facts.declaration_forest(spark, SF)).count() > 0
    assert {up for up, _ in seen} == {"origin", "scope"} and not any("Join" in p or "get_json_object" in p for _, p in seen)


def test_point_lookups_deal_points_and_spans_once(spark):
    rng = random.Random(4)
    spans = [(f"f{rng.randrange(2)}", 1, a := rng.randrange(-70, 140), a + rng.choice([0, 1, 2, 31, 32, 33, 100]), rng.choice("xyz"), rng.choice(["Read", "Called"])) for _ in range(150)]
    points = [(f"f{rng.randrange(2)}", 1, rng.randrange(-100, 280)) for _ in range(250)]
    refs = spark.createDataFrame([*spans, *spans[:40]], "file string, line long, start_col long, end_col long, symbol string, kind string").withColumn("symbol_type", F.lit("Class"))
    got = xref.point_in_span(refs, spark.createDataFrame(points, "file string, line long, col int"))
    best = {(f, n, c): min(((-a, e, s, k) for g, _, a, e, s, k in spans if g == f and a <= c < e), default=None) for f, n, c in points}
    assert sorted(tuple(r) for r in got.collect()) == sorted((*p, -b[0], *b[1:]) for p, b in best.items() if b) and dict(got.dtypes)["col"] == "int"
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
