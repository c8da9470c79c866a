"""Process records as a stream: the nearest known ancestor of each, from keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.trace import decode_pids, is_driver

RESULT = "trace string, line bigint, parent bigint, driver boolean, below boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Lines of a trace after which a process that has written nothing more is forgotten.
HORIZON = 10_000_000


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with a state store that can hold maps."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Ancestry(StatefulProcessor):
    """Of one trace: each process's last record, and whether that is a driver or stands below one."""

    def __init__(self, horizon: int) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "pid bigint, start bigint", "line bigint, covered boolean")
        self.swept = handle.getValueState("swept", "line bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen: dict[tuple, tuple | None] = {}
        own: dict[tuple, tuple] = {}  # each process is written once a batch
        first = not self.swept.exists()  # nothing is known yet, so nothing is asked for

        def look(process: tuple) -> tuple | None:
            if first:
                return seen.get(process)
            if process not in seen:
                seen[process] = tuple(self.known.getValue(process)) if self.known.containsKey(process) else None
            return seen[process]

        newest = 0
        for r in sorted(rows, key=lambda r: r["line"]):
            chain = [(p["pid"], p["start"]) for p in r["procs"] or ()]
            hits = [hit for p in chain[:-1] if (hit := look(p)) and hit[0] >= r["line"] - self.horizon]
            parent = hits[-1] if hits else None
            below = bool(parent and parent[1])
            if chain:
                seen[chain[-1]] = own[chain[-1]] = (r["line"], bool(r["driver"]) or below)
            newest = r["line"]
            yield Row(trace=key[0], line=r["line"], parent=parent[0] if parent else None, driver=r["driver"], below=below)
        for process, value in own.items():
            self.known.updateValue(process, value)
        last = 0 if first else self.swept.get()[0]
        if newest - last > self.horizon:  # twice the horizon is kept at most
            old = [k for k, v in self.known.iterator() if v[0] < newest - self.horizon]
            for k in old:
                self.known.removeKey(tuple(k))
            self.swept.update((newest,))
        elif first:
            self.swept.update((0,))

    def close(self) -> None:
        pass


def ancestry_stream(records: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """trace, line, parent, driver, below of a stream of records (trace, line, pidlist, argv), as trace.parents and trace.below_driver give them.

    Lines of a trace grow from one micro-batch to the next; within a batch they
    are taken in order. parent: the record of the nearest ancestor that is known
    when the line is written, null for none. A trace's state is its processes of
    the last ``horizon`` lines. Start it within map_state().
    """
    slim = decode_pids(records).select(F.col("trace").cast("string").alias("trace"), F.col("line").cast("bigint").alias("line"), "procs", is_driver(F.col("argv")).alias("driver"))
    return slim.where("line IS NOT NULL").groupBy("trace").transformWithState(Ancestry(horizon), RESULT, "append", "None")
