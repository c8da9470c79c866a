"""Streams: appended trace records, navigation sessions and incremental index refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.history import RESULT, History
from lodestone.operators.maintained import Definitions
from lodestone.operators.snapshots import Snapshots
from lodestone.operators.trace import decode_pids, is_driver
from lodestone.schema import TRACE
from lodestone.sources.store import materialise

STATE = "entries array<string>, cursor int"


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Trace records as they are appended to a folder of JSON lines, with their process lists decoded."""
    records = spark.readStream.schema(TRACE).json(folder)
    return decode_pids(records).withColumn("is_driver", is_driver(F.col("argv")))


def history_stream(events: DataFrame) -> DataFrame:
    """The history fold over a stream of events; events of one session within a batch are taken by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, cursor = state.get if state.exists else ([], -1)
        h = History(list(entries), cursor)
        pdf = pd.concat(list(batches)).sort_values("seq")
        rows = []
        for session, seq, action, place, origin in pdf[["session", "seq", "action", "place", "origin"]].itertuples(index=False):
            at = h.apply(action, place, origin)
            rows.append((session, seq, action, at, h.cursor, len(h.entries)))
        state.update((h.entries, h.cursor))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return events.groupBy("session").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def refresh_stream(changed: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Rebuild the entries whose inputs changed, a micro-batch at a time; rebuild must tolerate a batch that comes twice."""
    return changed.writeStream.foreachBatch(lambda df, _: rebuild(df.distinct())).option("checkpointLocation", checkpoint).start()


def snapshot_stream(changed: DataFrame, store: Snapshots, rebuild: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """A version of the archive for each micro-batch of changed entries (entry); rebuild gives the facts of some entries. A batch that comes twice changes nothing."""

    def step(df: DataFrame, batch: int) -> None:
        entries = materialise(df.select("entry").distinct())
        store.refresh(rebuild(entries), entries, f"batch-{batch}")

    return changed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def definitions_stream(changes: DataFrame, view: Definitions, checkpoint: str) -> StreamingQuery:
    """The maintained definitions, a micro-batch of signed facts at a time."""
    return changes.writeStream.foreachBatch(lambda df, batch: view.apply(materialise(df), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def symbol_activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """References per symbol kind and window of a stream (ts, kind), closed once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
