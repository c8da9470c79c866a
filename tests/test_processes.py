"""The process stream against the batch operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import trace
from lodestone.sources.facts import trace_records
from lodestone.streaming import processes

RECORDS = "trace string, line bigint, cwd string, pidlist array<bigint>, argv array<string>"
SF = "/root/testdata/sf0.001"


def stream(spark, batches, folder, horizon=processes.HORIZON):
    """Records of several micro-batches, taken in turn."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORDS).repartition(2).write.parquet(f"{folder}/in/{i}")
        with processes.map_state(spark):
            records = spark.readStream.schema(RECORDS).parquet(f"{folder}/in/*")
            q = processes.ancestry_stream(records, horizon).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
            q.awaitTermination()
    return {(r.trace, r.line): (r.parent, r.driver, r.below) for r in spark.read.parquet(f"{folder}/out").collect()}


def deltas(chain):
    out, before = [], (0, 0)
    for pid, start in chain:
        out += [pid - before[0], start - before[1]]
        before = (pid, start)
    return out


def builds(n, seed=0):
    """Records of two traces: chains below a shell, processes that exec again, unknown parents, null and empty lists."""
    rng, rows = random.Random(seed), []
    for t in ("a", "b"):
        known = [[(1, 0)]]
        for i in range(n):
            chain = rng.choice(known)
            if rng.random() < 0.8 or len(chain) == 1:
                chain = [*chain, (rng.randrange(100), i)]
            if rng.random() < 0.1:
                chain = [*chain[:-1], (777, i), chain[-1]]
            known.append(chain)
            rows.append((t, i + 1 + 10_000 * (t == "b"), "/", rng.choice([deltas(chain)] * 9 + [None, []]), rng.choice([["gcc", "-c", "x.c"], ["sh"], ["make"], None, []])))
    return rows


def batch(spark, rows):
    """The same by the batch operators, trace by trace."""
    out = {}
    for t in {r[0] for r in rows}:
        df = spark.createDataFrame([r for r in rows if r[0] == t], RECORDS)
        parent = {r.line: r.parent for r in trace.parents(df).collect()}
        below = {r.line for r in trace.below_driver(df).collect()}
        for r in df.select("line", trace.is_driver(F.col("argv")).alias("d")).collect():
            out[t, r.line] = (parent.get(r.line), r.d, r.line in below)
    return out


def test_batches_equal_the_whole(spark, tmp_path):
    rows = builds(60)
    cut = sorted(rows, key=lambda r: r[1] % 10_000)
    assert stream(spark, [cut[:50], cut[50:51], cut[51:]], str(tmp_path)) == batch(spark, rows)


def test_processes_are_forgotten(spark, tmp_path):
    """Beyond the horizon a process counts as unknown, and its state goes."""
    shell = deltas([(1, 0), (5, 5)])
    child = deltas([(1, 0), (5, 5), (9, 9)])
    rows = [("a", 1, "/", shell, ["gcc"]), ("a", 5, "/", child, ["x"]), ("a", 20, "/", child, ["y"]), ("a", 40, "/", shell, ["sh"]), ("a", 41, "/", child, ["z"])]
    got = stream(spark, [[r] for r in rows], str(tmp_path), horizon=10)
    assert got == {("a", 1): (None, True, False), ("a", 5): (1, False, True), ("a", 20): (None, False, False), ("a", 40): (None, False, False), ("a", 41): (40, False, False)}


def test_traces_of_events(spark):
    """The table's traces hold what the rules are about."""
    records = trace_records(spark, SF)
    found = records.select(F.count_if(F.col("pidlist").isNull()).alias("none"), F.count_if(F.size("pidlist") == 0).alias("empty"), F.count_if(F.col("argv").isNull()).alias("no_argv")).first()
    assert min(found) > 0
    assert trace.decode_pids(records).where("pidlist IS NULL AND size(procs) <> 0").count() == 0
    assert trace.parents(records.limit(0)).count() == 0 and trace.below_driver(records.limit(0)).count() == 0
