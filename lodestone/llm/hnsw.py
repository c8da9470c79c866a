"""Approximate nearest neighbours by one navigable small-world graph per shard.

Vectors that are equal in every component are one node that keeps its
smallest ids (as many as a result can need, so nothing is lost), which keeps
graphs whole however often a vector repeats. Nodes are dealt to cells by the
nearest of the pivots, which are a sample: one for every ``shard_rows`` nodes,
PIVOTS at most. A cell of more than ``shard_rows`` nodes is dealt by hash into
shards, so no shard grows with the table. Each shard's hierarchical navigable
small-world graph is built in one task and written as flat neighbour arrays;
a level's candidates are its nodes' nearest in the shard, by products of
blocks, and the diversity rule picks the links among them.

A query visits all shards of its PROBE nearest cells (of all cells, up to
PROBE * shard_rows nodes), so the work for a query doesn't grow with the table
up to PIVOTS * shard_rows nodes; beyond, by PROBE / PIVOTS of the shards. Where
cells are more than PROBE, recall rests on vectors being clustered: directions
without any order keep 0.84 where half of the cells are visited.
Queries of a shard are dealt in blocks. The shards' results are merged by exact
cosine on the original vectors, ties to the smaller id.

Vectors that are null, empty, all zero or hold a null or non-finite component
take no part, nor do rows with a null id. A shard's vectors must be of one
length; vectors of different lengths are never neighbours (cells are told apart
by length).

Edge cases: fewer candidates than k give all of them; equal rows (same id and
vector) count once; an id with several vectors is found once, by the nearest of
them, and as a query gets the k nearest to any of them; an empty table gives an
empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import spread_join, written

M = 16
EF_BUILD = 80
EF_SEARCH = 64
PIVOTS = 16_384
PROBE = 64
#: Nodes of a shard.
SHARD_ROWS = 8192
#: Queries to a block.
ASKED = 2048


class Graph:
    """Flat layout: node i's neighbours at level 0 are base[i, :], -1 where there is none; at a level above, upper[level - 1][i]."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7) -> None:
        norm = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
        self.unit = (vectors / norm).astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(np.int64), 12)
        self.base = np.full((n, 2 * m), -1, np.int32)
        self.top = int(self.level.max(initial=0))
        self.upper = [np.full((n, m), -1, np.int32) for _ in range(self.top)]
        self.entry, self.mark, self.stamp = int(self.level.argmax()) if n else -1, np.zeros(n, np.int64), 0
        for level in range(self.top + 1):
            self._connect(np.flatnonzero(self.level >= level), self._links(level), m, ef)

    @classmethod
    def from_arrays(cls, vectors: np.ndarray, base: np.ndarray, upper: list[np.ndarray], entry: int, top: int) -> Graph:
        g = cls.__new__(cls)
        norm = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
        g.unit = (vectors / norm).astype(np.float32)
        g.base, g.upper, g.entry, g.top = base, upper, entry, top
        g.mark, g.stamp = np.zeros(len(vectors), np.int64), 0
        return g

    def _links(self, level: int) -> np.ndarray:
        return self.base if level == 0 else self.upper[level - 1]

    def _search(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest found as (similarity, node), unordered; starts likewise."""
        links, unit, mark = self._links(level), self.unit, self.mark
        self.stamp += 1
        stamp = self.stamp
        open_ = [(-s, i) for s, i in starts]
        best = list(starts)
        heapq.heapify(open_)
        heapq.heapify(best)
        for _, i in starts:
            mark[i] = stamp
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[mark[near] != stamp]
            if not len(near):
                continue
            mark[near] = stamp
            sims = unit[near] @ q
            if len(best) >= ef:
                ok = sims > best[0][0]
                near, sims = near[ok], sims[ok]
            for x, j in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (x, j))
                    heapq.heappush(open_, (-x, j))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, j))
                    heapq.heappush(open_, (-x, j))
        return best

    def _diverse(self, near: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
        """Columns of the k links of each row: candidates (nearest first; similarity -inf: none) that are nearer to the row than to any link taken before, filled up with the nearest left out."""
        x = self.unit[near]
        between = x @ x.transpose(0, 2, 1)
        kept, worst = np.zeros(near.shape, bool), np.full(near.shape, -np.inf, np.float32)
        for a in range(near.shape[1]):
            ok = (worst[:, a] < sims[:, a]) & (kept.sum(1) < k)
            kept[:, a] = ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, :, a]), worst)
        return np.argsort(~kept + 2 * np.isneginf(sims), axis=1, kind="stable")[:, :k]

    def _connect(self, ids: np.ndarray, links: np.ndarray, m: int, ef: int) -> None:
        """Links of one level: m of each node's ef nearest, and back, at most as many as a row holds."""
        n, k = len(ids), min(ef, len(ids) - 1)
        if not k:
            return
        x = self.unit[ids]
        step = max(8, min(1024, (1 << 22) // (k * (k + x.shape[1]))))
        edges = []
        for a in range(0, n, step):
            sims = x[a : a + step] @ x.T
            own = np.arange(len(sims))
            sims[own, a + own] = -np.inf
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
            picked = self._diverse(ids[near], np.take_along_axis(sims, near, 1), m)
            edges.append(np.column_stack([np.repeat(a + own, picked.shape[1]), np.take_along_axis(near, picked, 1).reshape(-1)]))
        forth = np.concatenate(edges)
        pairs = np.unique(np.concatenate([forth, forth[:, ::-1]]), axis=0)
        starts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        width = links.shape[1]
        for i in range(n):
            near = pairs[starts[i] : starts[i + 1], 1]
            if len(near) > width:
                sims = x[near] @ x[i]
                by = np.argsort(-sims, kind="stable")[: 8 * width]
                near = near[by][self._diverse(ids[near[by]][None], sims[by][None], width)[0]]
            links[ids[i], : len(near)] = ids[near]

    def nearest(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        """Nodes of the ef nearest found, nearest first; k at least."""
        if self.entry < 0:
            return []
        at = [(float(self.unit[self.entry] @ q), self.entry)]
        for level in range(self.top, 0, -1):
            at = self._search(q, at, 8 if level == 1 else 2, level)
        return [i for _, i in sorted(self._search(q, at, max(ef, k), 0), reverse=True)]


def usable(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & some)


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: v and ids, its keep smallest ids. First inside each map task, so that a vector that repeats without end meets in no task."""
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    part = rows.withColumn("p", F.pmod(F.spark_partition_id(), F.lit(4096)))
    first = part.groupBy("v", "p").agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"))
    return first.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def sample_pivots(own: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Unit vectors of the sample by length: the nodes of the least hashes, PIVOTS at most."""
    n = min(PIVOTS, -(-own.count() // shard_rows))
    by: dict[int, list] = {}
    for r in own.select("v").orderBy(F.xxhash64("v"), "v").limit(n).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {d: (x := np.array(v)) / np.linalg.norm(x, axis=1, keepdims=True) for d, v in by.items()}


def with_cells(rows: DataFrame, pivots: dict[int, np.ndarray], many: int) -> DataFrame:
    """rows with cells array<string>: the cells of each v's many nearest pivots; a length without a pivot has one cell."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                dims = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
                cells: list[list[str]] = [[f"{d}:"] for d in dims.tolist()]
                for d in np.unique(dims).tolist():
                    if d in shared.value:
                        of = np.flatnonzero(dims == d)
                        sims = b.column("v").take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), d) @ shared.value[d].T
                        k = min(many, sims.shape[1])
                        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                        for i, own in zip(of.tolist(), near.tolist(), strict=True):
                            cells[i] = [f"{d}:{c}" for c in own]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.string()))], [*b.schema.names, "cells"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<string>")


INDEX = "shard string, vectors binary, ids array<array<long>>, base binary, upper array<binary>, entry int, top int, dim int"


@dataclass
class Index:
    """shards: one row per shard (INDEX); cells: cell, subs (shards of a cell); pivots by length of vectors."""

    shards: DataFrame
    cells: DataFrame
    pivots: dict[int, np.ndarray]


def _shard(cell: Column, sub: Column) -> Column:
    return F.concat_ws("/", cell, sub.cast("string"))


def build(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> Index:
    """The index of rows (id, v); shards with their vectors, ids and flat neighbour arrays are written to the shared folder."""
    own = written(nodes(rows, keep))
    pivots = sample_pivots(own, shard_rows)
    own = with_cells(own, pivots, 1).select("v", "ids", F.get("cells", F.lit(0)).alias("cell"))
    cells = written(own.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("subs")))
    own = spread_join(own, cells, ["cell"], F.col("v")).select("v", "ids", _shard(F.col("cell"), F.pmod(F.xxhash64("v"), F.col("subs"))).alias("shard"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[x[0] for x in pdf["ids"]], key=[tuple(x) for x in pdf["v"]]).sort_values(["first", "key"])
        vectors = np.array(pdf["v"].tolist(), dtype=np.float64)
        g = Graph(vectors)
        row = (pdf["shard"].iloc[0], vectors.tobytes(), pdf["ids"].tolist(), g.base.tobytes(), [u.tobytes() for u in g.upper], g.entry, g.top, vectors.shape[1])
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return Index(written(own.groupBy("shard").applyInPandas(make, INDEX)), cells, pivots)


def search(index: Index, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, probe: int = PROBE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest others. queries: id and v as from usable()."""
    asked = with_cells(queries.distinct(), index.pivots, probe).select(F.col("id").alias("query_id"), "v", F.explode("cells").alias("cell"))
    asked = spread_join(asked, index.cells, ["cell"], F.col("query_id")).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).select("query_id", "v", _shard(F.col("cell"), F.col("sub")).alias("shard"))
    per = written(asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("long").alias("blocks")))
    asked = spread_join(asked, per, ["shard"], F.col("query_id")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    shards = index.shards.join(per, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def find(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            s = left.iloc[0]
            dim = int(s["dim"])
            vectors = np.frombuffer(s["vectors"], np.float64).reshape(-1, dim)
            n = len(vectors)
            base = np.frombuffer(s["base"], np.int32).reshape(n, -1)
            g = Graph.from_arrays(vectors, base, [np.frombuffer(u, np.int32).reshape(n, -1) for u in s["upper"]], int(s["entry"]), int(s["top"]))
            for query, v in zip(right["query_id"].tolist(), right["v"], strict=True):
                out += [(query, i, x) for i, x in nearest_ids(g, vectors, s["ids"], query, np.asarray(v, np.float64), k, ef)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = shards.drop("blocks").groupBy("shard", "block").cogroup(asked.drop("blocks").groupBy("shard", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_ids(g: Graph, vectors: np.ndarray, ids: list, query: int, q: np.ndarray, k: int, ef: int) -> list[tuple[int, float]]:
    """The k nearest ids found in a shard with their cosines; the search widens while too few ids are in sight."""
    unit = (q / np.linalg.norm(q)).astype(np.float32)
    while True:
        found = np.array(g.nearest(unit, k + 1, ef))
        near = vectors[found]
        score = (near @ q) / np.sqrt((near * near).sum(1) * (q @ q))
        best: dict[int, float] = {}
        last = math.inf
        for a in np.argsort(-score, kind="stable").tolist():
            if len(best) >= k and score[a] < last:
                break
            for i in ids[found[a]]:
                if i != query:
                    best.setdefault(int(i), float(score[a]))
            last = score[a]
        if len(best) >= k or len(found) < ef or ef >= len(vectors):
            return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]
        ef *= 2


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, probe: int = PROBE) -> DataFrame:
    """The k nearest of vectors (vec_id, embedding) to each row of queries (the same columns), the row's own id left out."""
    return search(build(usable(vectors), k + 1, shard_rows), usable(queries), k, probe=probe)
