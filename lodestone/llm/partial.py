"""Product codes of vectors by partial-distance search.

A vector is cut into PARTS consecutive parts, each coded by the nearest entry
of that part's codebook (squared Euclidean distance of integers, ties to the
lower entry). Codebooks start as the vectors of the smallest ids and take
ROUNDS rounds of assignment and componentwise floored means.

The search goes through a part's dimensions in descending variance of its
codebook, a few at a time. After the first few, the entry that is nearest so
far is measured in full: that is the best complete distance. From then on only
pairs of vector and entry whose accumulated distance isn't above the best one
are carried on, by masks over the whole batch; those that reach the last
dimension are compared.

A round is one pass over the integer vectors, which are written once. A task
adds counts and sums per entry, so what leaves it is as large as the codebooks,
whatever the table; all sums are exact.

Edge cases: see ``vectors.integers`` for the rows that take no part. Of rows
with one id the smallest vector can seed an entry; rows without an id count as one
id, the last. Each row gets its code, repeated ones too. Fewer than ENTRIES ids
make as many entries. A length that PARTS doesn't divide makes the first parts
one longer. Components so large that a distance is beyond 64 bits raise. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import spread_join, written
from lodestone.llm.vectors import added, integers, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Dimensions to a step of the search; vectors that it takes at a time.
STEP, BATCH = 6, 512


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of x (integers), ties to the lower entry."""
    n, d = x.shape
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if d * (2 * largest) ** 2 < 1 << 31 else np.int64  # exact either way
    columns, entries = (np.ascontiguousarray(v[:, order].T, kind) for v in (x, book))
    so_far = np.zeros((n, len(book)), kind)
    for j in range(min(STEP, d)):
        off = columns[j][:, None] - entries[j]
        so_far += off * off
    best = ((columns - entries[:, so_far.argmin(axis=1)]) ** 2).sum(axis=0, dtype=kind)
    at = np.flatnonzero(so_far <= best[:, None])
    distance = so_far.ravel()[at]
    row, entry = np.divmod(at, len(book))
    for done in range(STEP, d, STEP):
        for j in range(done, min(done + STEP, d)):
            off = columns[j][row] - entries[j][entry]
            distance = distance + off * off
        alive = distance <= best[row]
        row, entry, distance = row[alive], entry[alive], distance[alive]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))[: len(row)]
    best = np.minimum.reduceat(distance, starts) if len(starts) else best  # of the complete distances, by row
    first = np.flatnonzero(distance == best[row])
    at = first[np.concatenate([[True], row[first[1:]] != row[first[:-1]]])[: len(first)]]  # entries ascend in a row
    return entry[at], best.astype(np.int64)


def _cuts(d: int) -> list[slice]:
    ends = np.cumsum([0, *map(len, np.array_split(np.arange(d), PARTS))]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _coded(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (n x PARTS) and error of each row."""
    code, error = np.zeros((len(x), PARTS), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BATCH):
        own = slice(at, at + BATCH)
        for p, cut in enumerate(_cuts(x.shape[1])):
            if cut.stop > cut.start:
                code[own, p], distance = nearest(x[own, cut], books[p])
                error[own] += distance
    return code, error


def _moved(rows: DataFrame, books: list[np.ndarray], d: int) -> list[np.ndarray]:
    """Codebooks after one round over all rows."""
    cuts, width = _cuts(d), max(b.shape[1] for b in books)
    shared = rows.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in shared.value], np.zeros((PARTS, len(shared.value[0])), np.int64)
        for b in batches:
            x = matrix(b.column("x"), d)
            code, _ = _coded(x, shared.value)
            for p, cut in enumerate(cuts):
                np.add.at(sums[p], code[:, p], x[:, cut])
                counts[p] += np.bincount(code[:, p], minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        values = pa.array([[int(counts[p, e]), *sums[p][e].tolist()] for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), values], ["part", "entry", "v"])

    found = added(rows.select("x").mapInArrow(add, "part int, entry int, v array<long>"), ["part", "entry"], width + 1).collect()  # PARTS * ENTRIES at most
    moved = [b.copy() for b in books]
    for r in found:
        own = moved[r["part"]]
        own[r["entry"]] = [v // r["v"][0] for v in r["v"][1 : own.shape[1] + 1]]
    return moved


def fit(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebook of each part (entries x dimensions of it), of rows (vec_id, x). Runs an action a round."""
    ids = rows.select(F.col("vec_id").alias("id")).distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries)
    own = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("id")))  # entries rows at most
    seeds = own.groupBy("id").agg(F.min("x").alias("first")).orderBy(F.col("id").asc_nulls_last()).collect()
    if not seeds:
        return []
    x = np.array([r["first"] for r in seeds], np.int64)
    d = x.shape[1]
    largest = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m")).collect()[0]["m"]
    if d * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact squared distances in 64 bits")
    books = [x[:, cut] for cut in _cuts(d)]
    for _ in range(rounds):
        books = _moved(rows, books, d)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code string (two hexadecimal digits a part), error long of rows (vec_id, label, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    d = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = _coded(matrix(b.column("x"), d), shared.value)
            spelled = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(spelled, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long")


def codes(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, one row per row of df that takes part."""
    rows = written(integers(df, SCALE))
    books = fit(rows)
    coded = written(encode(rows, books)).withColumn("no_label", F.col("label").isNull()).fillna("", ["label"])
    sums = coded.groupBy("no_label", "label").agg(F.sum("error").alias("label_error"))
    joined = spread_join(coded, sums, ["no_label", "label"], F.monotonically_increasing_id())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
