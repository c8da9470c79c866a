"""The strongest of overlapping spans at every place, as runs.

Places are cut into stretches. A span's own part goes to the stretches that its
two ends lie in; the stretches between them it covers whole, and it says so in
the few nodes of a binary tree over stretches that make up that range. So
a span costs the logarithm of its length, not the length. A stretch in which
anything begins or ends takes the strongest of what covers it from its ancestors
in the tree and is swept by itself, with a heap of what is open. Runs that go on
from one stretch into the next are put together by pointers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dictionary import ranked
from lodestone.operators.pointers import followed
from lodestone.sources.store import materialise

#: Places to a stretch.
STRETCH = 4096
LEVELS = 50


def swept(parts: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs (start, end, value), neighbours different, of the highest rank over each place. parts: start, end, rank, value in the order of start."""
    runs: list[tuple[int, int, str]] = []
    heap: list[tuple[int, int, str]] = []

    def close(upto: int | None, at: int) -> int:
        """Runs from at up to a place (None: to the end of all)."""
        while heap and (upto is None or at < upto):
            rank, end, value = heap[0]
            if end <= at:
                heapq.heappop(heap)
                continue
            to = end if upto is None else min(end, upto)
            if runs and runs[-1][1] == at and runs[-1][2] == value:
                runs[-1] = (runs[-1][0], to, value)
            else:
                runs.append((at, to, value))
            at = to
        return at if upto is None else upto

    at = 0
    for start, end, rank, value in parts:
        at = close(start, at)
        heapq.heappush(heap, (-rank, end, value))
    close(None, at)
    return runs


def _stretches(parts: DataFrame) -> DataFrame:
    """key, k, start, end, value of the runs of each stretch (key, k, start, end, rank, value), uncovered places and all to its end left out."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select("key", "k", "start", "end", "rank", "value").repartition(n, "key", "k").sortWithinPartitions("key", "k", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []

        def out(groups: list) -> pa.RecordBatch:
            rows = [(*g, *r) for g, parts in groups for r in swept(parts)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["key", "k", "start", "end", "value"])

        for b in batches:
            groups = []
            for key, k, *part in zip(*(b.column(c).to_pylist() for c in ("key", "k", "start", "end", "rank", "value")), strict=True):
                if (key, k) != at:
                    if own:
                        groups.append((at, own))
                    at, own = (key, k), []
                if part[1] > part[0]:
                    own.append(tuple(part))
            yield out(groups)
        if own:
            yield out([(at, own)])

    return dealt.mapInArrow(run, "key long, k long, start long, end long, value string")


def top_runs(spans: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """keys, start, end, value: maximal runs of one value, by the span of the highest rank over each place.

    spans: keys, start, end (bigint), rank (bigint), value. Of spans of one rank
    over a place the greater value counts. Empty spans and null values are left
    out; null keys are one key. Runs actions.
    """
    c = F.col
    best = F.max(F.struct("rank", "value")).alias("top")
    live = materialise(spans.where("`end` > start AND value IS NOT NULL AND rank IS NOT NULL").groupBy(*keys, c("start").cast("bigint").alias("start"), c("end").cast("bigint").alias("end")).agg(best))
    names = ranked(live.select(*keys).distinct(), list(keys), "key")
    same = [live[x].eqNullSafe(names[x]) for x in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    k = lambda x: F.floor(x / stretch).cast("bigint")
    # ranks become dense numbers in which the value decides between equal ones
    order = ranked(live.select("top").distinct(), ["top"], "rank")
    live = live.join(names, on).select("key", "start", "end", "top").join(order, "top").select("key", "start", "end", "rank", c("top.value").alias("value"), k(c("start")).alias("a"), k(c("end")).alias("b"))
    live = materialise(live)
    head = live.select("key", c("a").alias("k"), "start", F.least("end", (c("a") + 1) * stretch).alias("end"), "rank", "value")
    tail = live.where("b > a").select("key", c("b").alias("k"), (c("b") * stretch).alias("start"), "end", "rank", "value")
    levels = live.where("b > a + 1").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    node = lambda x: F.call_function("shiftright", x, c("level"))
    low = node(c("a")) + 1  # ceiling of (a + 1) / 2^level
    levels = levels.withColumn("lo", low).withColumn("hi", node(c("b"))).where("lo < hi")
    picked = F.array_compact(F.array(F.when(c("lo") % 2 == 1, c("lo")), F.when(c("hi") % 2 == 1, c("hi") - 1)))
    nodes = materialise(levels.withColumn("node", F.explode(picked)).groupBy("key", "level", "node").agg(F.max(F.struct("rank", "value")).alias("top")))
    deepest = nodes.agg(F.max("level").alias("m")).collect()[0]["m"]
    parts = head.unionByName(tail)
    active = materialise(parts.select("key", "k").distinct())
    if deepest is not None:
        up = active.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("node", node(c("k")))
        cover = up.join(nodes, ["key", "level", "node"]).groupBy("key", "k").agg(F.max("top").alias("top"))
        parts = parts.unionByName(cover.select("key", "k", (c("k") * stretch).alias("start"), ((c("k") + 1) * stretch).alias("end"), "top.rank", "top.value"))
    runs = materialise(_stretches(parts))
    return _together(runs, active, stretch).join(names, "key").select(*keys, "start", "end", "value")


def _together(runs: DataFrame, active: DataFrame, stretch: int) -> DataFrame:
    """Runs of active stretches, put together across them; between two of them the last value goes on."""
    c = F.col
    numbered = ranked(active, ["key", "k"], "n")
    after = numbered.select((c("n") - 1).alias("n"), c("key").alias("next_key"), c("k").alias("next_k"))
    begin, stop = c("k") * stretch, (c("k") + 1) * stretch
    ends = runs.groupBy("key", "k").agg(F.min(F.struct("start", "end", "value")).alias("first"), F.max(F.struct("start", "end", "value")).alias("last"))
    at = numbered.join(after, "n", "left").join(ends, ["key", "k"], "left")
    reach = F.when(c("next_key") == c("key"), c("next_k") * stretch).otherwise(stop)
    at = at.select(
        "n", "key", "k", reach.alias("reach"), F.when(c("first.start") == begin, c("first.value")).alias("in_value"), c("first.end").alias("first_end"), F.when(c("last.end") == stop, c("last.value")).alias("out_value"),
        F.coalesce((c("first.start") == begin) & (c("first.end") == stop), F.lit(False)).alias("whole"), (c("next_key") == c("key")).alias("has_next"),
    )
    at = materialise(at)
    following = at.select((c("n") - 1).alias("n"), c("in_value").alias("next_value"), c("first_end").alias("next_end"), c("whole").alias("next_whole"))
    before = at.select((c("n") + 1).alias("n"), c("key").alias("before_key"), c("out_value").alias("before_value"))
    link = at.join(following, "n", "left").join(before, "n", "left")
    goes_on = F.coalesce(c("has_next") & (c("out_value") == c("next_value")), F.lit(False))
    link = link.select(
        "key", "k", "n", F.when(goes_on & c("next_whole"), c("n") + 1).alias("up"), F.when(goes_on & ~c("next_whole"), c("next_end")).otherwise(c("reach")).alias("ends_at"),
        F.coalesce((c("before_key") == c("key")) & (c("before_value") == c("in_value")), F.lit(False)).alias("goes_on_here"),
    )
    link = materialise(link)
    end = followed(link.select("n", "up", "ends_at"), "n", "up", {"ends_at": lambda near, far: F.coalesce(far, near)})
    told = link.join(end.withColumnRenamed("ends_at", "tail"), "n").select("key", "k", "tail", "goes_on_here")
    own = runs.join(told, ["key", "k"])
    last = c("end") == stop
    return own.where(~(c("goes_on_here") & (c("start") == begin))).select("key", "start", F.when(last, c("tail")).otherwise(c("end")).alias("end"), "value")
