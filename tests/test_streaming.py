from __future__ import annotations

import json

from lodestone.operators.history import fold
from lodestone.streaming.sessions import history_stream, refresh_stream, symbol_activity, trace_stream

EVENTS = "session string, seq bigint, action string, place string, origin string"


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_history_stream_equals_batch(spark, tmp_path):
    events = [("a", i, ["jump", "back", "jump", "forward"][i % 4], f"p{i % 3}", None) for i in range(20)]
    for k in range(2):
        spark.createDataFrame(events[k * 10 : k * 10 + 10], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in run(spark, history_stream(stream), "hist").collect())
    assert got == sorted(tuple(r) for r in fold(spark.createDataFrame(events, EVENTS)).collect())


def test_trace_stream(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"cwd": "/", "pidlist": [1, 2, 3, 4], "argv": ["gcc", "x"]}) + "\n")
    row = run(spark, trace_stream(spark, str(tmp_path)), "tr").first()
    assert row["is_driver"] and [tuple(p) for p in row["procs"]] == [(1, 2), (4, 6)]


def test_activity(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'Read' AS kind UNION ALL SELECT timestamp'2024-01-02 00:00:00', 'Called'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    assert run(spark, symbol_activity(stream), "act").where("kind = 'Read'").first()["n"] == 1


def test_refresh_stream(spark, tmp_path):
    spark.sql("SELECT '@/a' AS name UNION ALL SELECT '@/a' UNION ALL SELECT '@/b'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string").parquet(str(tmp_path / "in"))
    q = refresh_stream(stream, lambda df: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["@/a", "@/b"]
