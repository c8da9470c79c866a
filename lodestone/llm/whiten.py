"""Whitened embeddings by a covariance computed in tiles of dimension pairs.

1. Each row-block (the rows of a batch, ROWS at most) is cut into column blocks
   of TILE dimensions.
2. Every two column blocks of a row-block meet under their tile's key and are
   multiplied, centred before that on the exact means. A column block goes to as
   many tiles as there are column blocks.
3. The products are added per tile, in each task first; the assembled matrix,
   whose size is that of the dimensions squared, is decomposed on the driver.
4. Rows are projected on the leading COMPONENTS components, by the roots of their
   eigenvalues. The covariance of what came out is summed over all rows too.

Edge cases: see ``vectors.integers`` for the rows that take no part; rows that
repeat or share an id count each. A component without variance (an eigenvalue
of at most 1e-12 of the trace, as in tables of fewer rows than dimensions) has
whitened 0 and is left out of identity_error. deviation is null where its exact
value is beyond 64 bits. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.vectors import added, integers, matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Dimensions to a column block, rows to a row-block.
TILE, ROWS = 32, 1024


def moments(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Exact number of rows and sums of each dimension of rows (x array<long>)."""
    n, *sums = rows.agg(F.count("*"), *(F.sum(F.get("x", F.lit(i))) for i in range(d))).collect()[0]
    return n, sums


def covariance(rows: DataFrame, n: int, sums: list[int], tile: int = TILE) -> np.ndarray:
    """d x d covariance (divisor n) of rows (x array<long>)."""
    d = len(sums)
    mean = np.array([s / n for s in sums])
    k = -(-d // tile)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = matrix(b.column("x").slice(at, ROWS), d) - mean
                blocks = [np.ascontiguousarray(x[:, c * tile : (c + 1) * tile]).tobytes() for c in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{count}"] * k), pa.array(range(k), pa.int32()), pa.array([len(x)] * k, pa.int32()), pa.array(blocks, pa.binary())], ["block", "c", "n", "x"])
                count += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            lines = [(i, j, k, row) for (i, j), product in held.items() for k, row in enumerate(product.tolist())]
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in lines], pa.int32()) for c in range(3)), pa.array([x[3] for x in lines], pa.list_(pa.float64()))], ["i", "j", "k", "v"])

        for b in batches:
            for i, j, m, x, y in zip(*(b.column(c) for c in ("i", "j", "n", "x", "y")), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), "<f8").reshape(m.as_py(), -1) for v in (x, y))
                key = i.as_py(), j.as_py()
                product = left.T @ right
                held[key] = held[key] + product if key in held else product
            if len(held) > 1024:
                yield out()
        yield out()

    blocks = written(rows.select("x").mapInArrow(cut, "block string, c int, n int, x binary"))
    left = blocks.withColumnRenamed("c", "i")
    right = blocks.select("block", F.col("c").alias("j"), F.col("x").alias("y"))
    pairs = left.join(right.hint("merge"), "block").where("i <= j").select("i", "j", "n", "x", "y")
    lines = added(pairs.mapInArrow(multiply, "i int, j int, k int, v array<double>"), ["i", "j", "k"], tile)
    v = np.zeros((d, d))
    for r in lines.collect():  # d * d / 2 numbers and their tile's other half
        at, own = r["i"] * tile + r["k"], np.array([x for x in r["v"] if x is not None])
        cut = slice(r["j"] * tile, r["j"] * tile + len(own))
        v[at, cut] = v[cut, at] = own
    return v / n


def principal(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) by falling eigenvalue, the eigenvalues and their shares of the trace."""
    e, vectors = np.linalg.eigh(v)
    e, vectors = np.maximum(e[::-1], 0)[:components], vectors[:, ::-1][:, :components]
    trace = np.trace(v)
    return vectors, np.where(e > 1e-12 * trace, e, 0), e / trace if trace > 0 else np.zeros_like(e)


def project(rows: DataFrame, n: int, sums: list[int], vectors: np.ndarray, e: np.ndarray) -> DataFrame:
    """vec_id, deviation long, w array<double> (whitened components) of rows (vec_id, x)."""
    mean, d = np.array([s / n for s in sums]), len(sums)
    weights = vectors * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0)
    own = rows.sparkSession.sparkContext.broadcast((mean, weights, np.array(sums, np.int64)))  # d * (COMPONENTS + 2) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, weights, sums = own.value
        for b in batches:
            x = matrix(b.column("x"), d)
            w = (x - mean) @ weights
            off = n * x - sums
            fits = (off.astype(np.float64) ** 2).sum(axis=1) < 9.2e18
            with np.errstate(over="ignore"):
                deviation = pa.array((off * off).sum(axis=1), mask=~fits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, lists], ["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(projected: DataFrame, e: np.ndarray) -> float:
    """Largest absolute entry of the covariance of w minus the identity, over the components with variance."""
    k = len(e)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = np.hstack([np.ones((b.num_rows, 1)), matrix(b.column("w"), k)])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(total.tolist())], ["k", "v"])

    got = added(projected.select("w").mapInArrow(add, "k int, v array<double>"), ["k"], k + 1).orderBy("k").collect()
    total = np.array([r["v"] for r in got])
    mean, squares = total[0, 1:] / total[0, 0], total[1:, 1:] / total[0, 0]
    error = np.abs(squares - np.outer(mean, mean) - np.eye(k))[np.ix_(e > 0, e > 0)]
    return float(error.max()) if error.size else 0.0


def whitened(df: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: components rows per row of df that takes part."""
    rows = written(integers(df, SCALE, OFFSET))
    first = rows.limit(1).collect()
    if not first:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    n, sums = moments(rows, len(first[0]["x"]))
    vectors, e, share = principal(covariance(rows, n, sums, tile), components)
    projected = written(project(rows, n, sums, vectors, e))
    error = identity_error(projected, e)
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    explained = F.get(F.array(*map(F.lit, share.tolist())), F.col("c"))
    return each.select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
