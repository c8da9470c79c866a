"""Toxicity grades by cumulative-link (proportional-odds) ordinal regression.

Features are the hashed lower-case words of a text and their 4, 5 and 6 byte
beginnings (a stem speaks for endings that no labelled row has), each present
or not. One weight vector serves all ordered thresholds:
P(grade > j) = sigmoid(w.x - theta_j). The expected severity is the sum of
those probabilities.

Labels are binary, so the fit grades a toxic document by how many different
marker words (words whose log-odds single out the toxic class) it holds: 1 up
to 2, 2 up to 5, 3 beyond. The fit uses at most ``max_labelled`` labelled
rows, picked by a hash of their id; every document is scored over its whole
text.

Edge cases: a null or wordless text scores as one without features; rows that
repeat, share an id or have none are scored each by their own text; of rows that
share a labelled id one (of the least text hash) is fitted on; a doc_id with
contradicting labels counts as toxic;
labels with a null id or flag, or without a document, are left out; without
any usable label of both classes every document gets grade 0 and severity 0.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
GRADES = 3
STEMS = (4, 5, 6)
#: Words that a task remembers; it starts anew beyond.
MEMO = 400_000
#: Different marker words above which a toxic document is of grade 2 and 3.
GRADE_CUTS = (2, 5)
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))  # ASCII punctuation becomes a space


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def features(word: bytes) -> list[int]:
    """Even: the word; odd: its beginnings."""
    mask = (1 << BITS) - 2
    return [zlib.crc32(word) & mask] + [zlib.crc32(b"^" + word[:k]) & mask | 1 for k in STEMS if len(word) > k]


@dataclass
class OrdinalModel:
    weights: dict[int, float]
    thresholds: list[float]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        w, memo, out = self.weights, {}, np.zeros(len(texts))
        for i, text in enumerate(texts) if w else ():
            found: set[int] = set()
            for word in set(words(text)):
                known = memo.get(word)
                if known is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    known = memo[word] = tuple(h for h in features(word) if h in w)
                found.update(known)
            out[i] = sum(w[h] for h in sorted(found))
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        index = [sorted({h for word in set(words(text)) for h in features(word)}) for text in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(index, pa.list_(pa.int32()))], ["doc_id", "toxic", "index"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_features: int = 4096) -> OrdinalModel:
    """Fit on at most max_labelled labelled documents; features and weights are bounded by max_features."""
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = sample.count()
    if n > 2 * max_labelled:  # else every task would send its own max_labelled rows to one place
        share = F.shiftrightunsigned(F.xxhash64("doc_id").bitwiseXOR(-(1 << 63)), 11) / F.lit(float(1 << 53))  # in the hash's own order
        sample = sample.where(share < 1.5 * max_labelled / n)
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")
    got = rows.mapInArrow(_features, "doc_id long, toxic int, index array<int>").toArrow()
    if not got.num_rows:
        return OrdinalModel({}, [0.0] * GRADES)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    got = got.take(pa.array(order))
    lists = got.column("index").combine_chunks()
    toxic, sizes, index = got.column("toxic").to_numpy() > 0, lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
    del got, lists
    model = fit_grades(toxic, sizes, index, max_features)
    del sizes, index
    pa.default_memory_pool().release_unused()
    return model


def fit_grades(toxic: np.ndarray, sizes: np.ndarray, index: np.ndarray, max_features: int = 4096) -> OrdinalModel:
    """toxic: per row; index: the rows' features one after another, as many as sizes says."""
    n, row = len(toxic), np.repeat(np.arange(len(toxic), dtype=np.int32), sizes)
    n1 = int(toxic.sum())
    if not n1 or n1 == n:
        return OrdinalModel({}, [0.0] * GRADES)
    with_, without = (np.bincount(index[on[row]], minlength=1 << BITS) for on in (toxic, ~toxic))
    often = np.flatnonzero(with_ + without >= 2)
    df1, df0 = with_[often].astype(float), without[often].astype(float)
    del with_, without
    odds = np.log((df1 + 0.5) / (n1 - df1 + 0.5)) - np.log((df0 + 0.5) / (n - n1 - df0 + 0.5))
    z = odds / np.sqrt(1 / (df1 + 0.5) + 1 / (df0 + 0.5))
    top = np.argsort(-np.abs(z), kind="stable")[:max_features]
    top = top[np.abs(z[top]) > 1.5]
    strong, z, df1, df0 = often[top], z[top], df1[top], df0[top]
    if not len(strong):
        return OrdinalModel({}, [0.0] * GRADES)
    at = np.full(1 << BITS, -1, np.int32)
    at[strong] = np.arange(len(strong))
    keep = at[index] >= 0
    r, c = row[keep], at[index[keep]]
    marker = (z > 3) & (df1 >= 4 * df0) & (strong % 2 == 0)
    hits = np.bincount(r, weights=marker[c], minlength=n)
    grade = np.where(toxic, 1 + (hits > GRADE_CUTS[0]) + (hits > GRADE_CUTS[1]), 0)

    k = len(strong)
    w, theta0, gaps = np.zeros(k), np.log((n - n1) / n1), np.zeros(GRADES - 1)
    params = np.concatenate([w, [theta0], gaps])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    rare = 1 / np.sqrt(df1 + df0)
    for step in range(1, 301):
        w, theta = params[:k], params[k] + np.concatenate([[0], np.cumsum(np.exp(params[k + 1 :]))])
        s = np.bincount(r, weights=w[c], minlength=n)
        above = np.column_stack([np.ones(n), *(sig(s - t) for t in theta), np.zeros(n)])  # P(grade >= j)
        p = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        up, down = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p  # d log p / d (s - theta)
        ds = (up - down) / n
        dtheta = np.array([-(up[grade == j + 1]).sum() + (down[grade == j]).sum() for j in range(GRADES)]) / n
        g = np.concatenate([np.bincount(c, weights=ds[r], minlength=k) - (1e-4 * rare + 2e-5) * w, [dtheta.sum()], [np.exp(params[k + 1 + j]) * dtheta[j + 1 :].sum() for j in range(GRADES - 1)]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        params = params + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        # proximal step: noise words lose their weight
        shrink = 0.004 * rare / rare.max()
        params[:k] = np.sign(params[:k]) * np.maximum(np.abs(params[:k]) - shrink, 0)
    theta = params[k] + np.concatenate([[0], np.cumsum(np.exp(params[k + 1 :]))])
    return OrdinalModel({int(h): float(x) for h, x in zip(strong, params[:k], strict=True) if x}, [float(t) for t in theta])


def _above(m: OrdinalModel, texts: list[str | None]) -> list[np.ndarray]:
    """P(grade > j) of each text, for j = 0, 1, ..."""
    s = m.logits(texts)
    return [1 / (1 + np.exp(-np.clip(s - t, -30, 30))) if m.weights else np.zeros(len(s)) for t in m.thresholds]


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, n_words, severity (expected), grade (most probable), p_toxic, toxic (p_toxic >= 0.5), one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            above = _above(shared.value, texts)
            n = [len((t or "").encode("utf-8", "replace").split()) for t in texts]
            cum = np.column_stack([np.ones(len(n)), *above, np.zeros(len(n))])
            grade = np.argmax(cum[:, :-1] - cum[:, 1:], axis=1).astype(np.int32)
            out = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sum(above)), pa.array(grade), pa.array(above[0]), pa.array(above[0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs whose own text isn't toxic, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_above(shared.value, b.column(at).to_pylist())[0] < 0.5))

    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)


def toxic_grades(docs: DataFrame, labels: DataFrame, **params: int) -> DataFrame:
    return score(docs, fit(docs, labels, **params))
