"""Near-duplicate classes by improved consistent weighted sampling.

A document's elements are its shingles of five lower-case words, the second
and later occurrences of a shingle as elements of their own (so term frequency
counts); shorter documents are one shingle. An element weighs its shingle's
inverse document frequency, ln(N / df) / ln(1 / RARE), at most 1: shingles in
less than a share RARE of all documents weigh 1, very common ones less, 0.05 at
least. df is counted over all documents in TABLE hash slots, a table of fixed
size; shingles of less than 20 documents weigh 1, so that copies in small
tables count in full.

1. Rows of the same words are one text; all that follows is keyed by texts.
2. Improved consistent weighted sampling draws ROWS * BANDS samples per
   text; the samples of a band make its bucket. A text with common
   shingles draws them a second time with all weights 1, so that it meets those
   that are like it by term frequencies alone.
3. In each bucket every two texts that no chain of links joins yet are
   compared by weighted Jaccard similarity over all their elements, with the
   document frequencies and with term frequencies alone; those of ``threshold``
   or more by either are linked. Once linked, a text needn't be compared with
   the rest of its group, so no group is expanded into pairs. A bucket of more
   than CHUNK texts or CHUNK_WORDS words is dealt into chunks by hash, and the
   chunks compared. What its chunks keep apart meets again by rare elements: of
   two texts that are alike each has a shared element among its rarest, so many
   that the rest weighs less than ``threshold`` of it (a prefix filter, exact for
   either weighting). Texts that a bucket holds only for a common passage share
   none of these. At the rarest element that two alike texts share, the lighter
   one has 2 t / (1 + t) of its weight left (t: ``threshold``); it seeks, the
   other needs not. In the group of an element those that seek, or those outside
   its largest component if these are fewer, are compared with all, in chunks.
4. Connected components of the links are the classes.

Two texts of similarity 0.8, by either weighting, share a bucket with a
chance of 0.9998. (Where only one has common shingles, none of these is shared,
and the weighted similarity is the higher one.)

Edge cases: null, empty and blank texts have the same (no) words and are one
class. Every row has a class by its own text: rows that repeat or share an id
are each returned, rows without an id too. A class is named by its smallest id,
null where none of its rows has one. An empty table gives an empty result;
extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLOCK, blocks_of, spread_join, vector_sum, word_array, written

SHINGLE = 5
BANDS, ROWS = 16, 4
TABLE = 1 << 20
RARE = 0.05
CHUNK = 256
CHUNK_WORDS = 1_000_000
#: Element meetings that a comparison holds at a time.
MEETINGS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(F.lower(text)), lambda w: F.xxhash64(w))


_STEPS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _P) | np.uint64(1)


def shingles(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a batch of word-hash lists, and the document (row) of each; documents in order."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(lists) else np.zeros(0, np.uint64)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words * _STEPS[0]
    for k in range(1, min(SHINGLE, n)):
        h[: n - k] += words[k:] * _STEPS[k]
    starts = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes < SHINGLE) & (sizes > 0))
    for i in short.tolist():  # one shingle of all words
        own = words[starts[i] : starts[i] + sizes[i]]
        h[starts[i]] = (own * _STEPS[: len(own)]).sum() + np.uint64(len(own))
    counts = np.where(sizes < SHINGLE, sizes > 0, sizes - SHINGLE + 1).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(row)) + (starts - (np.cumsum(counts) - counts))[row]
    return mix(h[at]), row


def elements(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shingle hashes with occurrences told apart: the first keeps its hash, a later one gets another."""
    key = mix(h + row.astype(np.uint64) * _Q)
    slot = (key & np.uint64((1 << 18) - 1)).view(np.int64)  # most keys share their slot with none
    some = np.flatnonzero(np.bincount(slot, minlength=1 << 18)[slot] > 1)
    by = some[np.argsort(key[some], kind="stable")]
    again = np.concatenate([[False], key[by[1:]] == key[by[:-1]]])
    at = np.arange(len(by))
    nth = (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64)
    out = h.copy()
    out[by] = np.where(nth > 0, mix(h[by] + nth * _P), h[by])
    return out


def _quantiles() -> np.ndarray:
    """4096 quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) e^-x."""
    p = (np.arange(4096) + 0.5) / 4096
    low, high = np.zeros(4096), np.full(4096, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low


GAMMA = _quantiles().astype(np.float32)
LN_GAMMA = np.log(_quantiles()).astype(np.float32)


def samples(h: np.ndarray, row: np.ndarray, ln_weight: np.ndarray, n: int, draws: int) -> np.ndarray:
    """n x draws samples (hashed); rows without elements get zeros. ln_weight: of each element; most are 0."""
    out = np.zeros((n, draws), np.uint64)
    if not len(h):
        return out
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    counts = np.diff(np.append(starts, len(row)))
    docs = row[starts]
    lighter = np.flatnonzero(ln_weight < 0)
    u, v = np.empty_like(h), np.empty_like(h)
    r, ln_c, beta, ln_a = (np.empty(len(h), np.float32) for _ in range(4))
    for j in range(draws):
        seed = mix(np.array([j + 1], np.uint64) * _P)[0]
        np.multiply(np.bitwise_xor(h, seed, out=u), mix(np.array([seed], np.uint64))[0] | np.uint64(1), out=u)
        np.take(GAMMA, np.right_shift(u, np.uint64(52), out=v).view(np.int64), out=r, mode="clip")
        np.right_shift(u, np.uint64(40), out=v)
        np.take(LN_GAMMA, np.bitwise_and(v, np.uint64(4095), out=v).view(np.int64), out=ln_c, mode="clip")
        np.right_shift(u, np.uint64(16), out=v)
        np.multiply(np.bitwise_and(v, np.uint64(0xFFFFFF), out=v).view(np.int64), np.float32(2.0**-24), out=beta, casting="unsafe")
        np.subtract(beta, np.float32(1), out=ln_a)  # of weight 1
        np.multiply(ln_a, r, out=ln_a)
        np.add(ln_a, ln_c, out=ln_a)
        t = None
        if len(lighter):
            t = np.floor(ln_weight[lighter] / r[lighter] + beta[lighter])
            ln_a[lighter] = ln_c[lighter] - r[lighter] * (t - beta[lighter]) - r[lighter]
        least = np.minimum.reduceat(ln_a, starts)
        won = np.flatnonzero(ln_a == np.repeat(least, counts))
        won = won[np.argsort(h[won], kind="stable")[::-1]] if len(won) > len(starts) else won
        best = np.zeros(n, np.int64)
        best[row[won]] = won  # of ties the smallest hash, which comes last
        pick = best[docs]
        value = h[pick].copy()
        if t is not None:
            level = np.zeros(len(h), np.int64)
            level[lighter] = t
            own = level[pick]
            value = np.where(own != 0, mix(value + own.astype(np.uint64) * _Q), value)  # the same at level 0 whatever the batch holds
        out[docs, j] = value
    return out


def _blocks(b: pa.RecordBatch, size: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many words each."""
    sizes = b.column("words").value_lengths().to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // size
    for k in np.unique(part):
        at = np.flatnonzero(part == k)
        yield b.slice(int(at[0]), len(at))


def slot_counts(docs: DataFrame) -> np.ndarray:
    """Documents per hash slot of their shingles, over all documents; TABLE numbers, whatever the input's size."""
    rows = docs.select(word_hashes(F.col("text")).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TABLE, np.int64)
        held: list[np.ndarray] = []
        for whole in batches:
            for b in _blocks(whole):
                h, row = shingles(b.column("words"))
                slot = row * TABLE + (h & np.uint64(TABLE - 1)).astype(np.int64)
                slot.sort()
                if len(slot):
                    slot = slot[np.concatenate([[True], slot[1:] != slot[:-1]])]
                held.append((slot & (TABLE - 1)).astype(np.int32))
            if sum(map(len, held)) > TABLE:
                df += np.bincount(np.concatenate(held), minlength=TABLE)
                held.clear()
        if held:
            df += np.bincount(np.concatenate(held), minlength=TABLE)
        yield blocks_of(df)

    return vector_sum(rows.mapInArrow(count, BLOCK))


def ln_idf(df: np.ndarray, n_docs: int, rare: float = RARE) -> np.ndarray:
    """Natural logarithm of each slot's weight, 0 for all but the common ones."""
    weight = np.log(max(n_docs, 1) / np.maximum(df, 1)) / math.log(1 / rare)
    weight = np.where(df < 20, 1.0, np.clip(weight, 0.05, 1.0))  # tiny tables have no common shingles
    return np.log(weight).astype(np.float32)


def _verify(docs: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], weights: list[np.ndarray | None], threshold: float) -> list[tuple[int, int]]:
    """Links that join components of one group: (text, text). sets: elements of each; weights: theirs, None where all are 1."""
    n = len(docs)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, x in enumerate(labels.tolist()):
        parent[root(i)] = root(seen.setdefault(x, i))
    if len(seen) < 2:
        return []
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(n), sizes)
    weight = np.concatenate([np.ones(k, np.float32) if w is None else w for w, k in zip(weights, sizes, strict=True)])
    total, size = np.bincount(owner, weights=weight, minlength=n), np.array(sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(ids, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    members, begin = owner[by], np.concatenate([[0], np.cumsum(sizes)])
    links, left = [], len(seen)
    for i in range(n):
        if left < 2:
            break
        mine = slice(begin[i], begin[i + 1])
        first, last = edges[ids[mine]], edges[ids[mine] + 1]
        k = last - first
        if not k.sum():
            continue
        inter, shared = np.zeros(n), np.zeros(n, np.int64)
        part = np.cumsum(k) // MEETINGS
        for at in np.split(np.arange(len(k)), np.flatnonzero(np.diff(part)) + 1):  # long documents in parts
            own_k = k[at]
            flat = np.repeat(first[at] - (np.cumsum(own_k) - own_k), own_k) + np.arange(own_k.sum())
            inter += np.bincount(members[flat], weights=np.repeat(weight[mine][at], own_k), minlength=n)
            shared += np.bincount(members[flat], minlength=n)
        alike = (inter >= threshold * (total + total[i] - inter) - 1e-9) | (shared >= threshold * (size + size[i] - shared) - 1e-9)
        near = np.flatnonzero(alike)
        for j in near.tolist():
            if j != i and root(i) != root(j):
                parent[root(i)] = root(j)
                links.append((int(docs[i]), int(docs[j])))
                left -= 1
    return links


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges a, b of rows (group, doc, label long, els, weights binary), each group in one place."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "group").sortWithinPartitions("group", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(held) > 1:
                sets = [np.frombuffer(x[3], "<u8") for x in held]
                weights = [None if x[4] is None else np.frombuffer(x[4], "<f4") for x in held]
                out.extend(_verify(np.array([x[1] for x in held]), np.array([x[2] for x in held]), sets, weights, threshold))
            held.clear()

        def links() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                for r in zip(*(part.column(c).to_pylist() for c in ("group", "doc", "label", "els", "weights")), strict=True):
                    if held and held[0][0] != r[0]:
                        flush()
                    if not held or held[-1][1] != r[1]:
                        held.append(r)
            yield links()
            out.clear()
        flush()
        yield links()

    return dealt.select("group", "doc", "label", "els", "weights").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each id's connected component, for the ids that edges (a, b) names."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        least = written(least)  # named twice below
        heads = least.select("label").distinct().join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label")
        new = written(spread_join(least, heads, ["label"], F.col("id"), "left").select("id", F.least("label", "next").alias("label"), "old"))
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def _keys(s: np.ndarray, bands: int, rows_: int) -> np.ndarray:
    """A bucket for each band of a document's samples."""
    keys = np.zeros((len(s), bands), np.uint64)
    for k in range(bands):
        x = np.full(len(s), k + 1, np.uint64)
        for j in range(rows_):
            x = mix(x * _P + s[:, k * rows_ + j])
        keys[:, k] = x
    return keys


def same_words(words: Column) -> Column:
    """Key of a text: equal for equal words."""
    return F.concat_ws(",", F.xxhash64(words), F.hash(words), F.size(words))


def _sampled(docs: DataFrame, idf: object, bands: int, rows_: int) -> DataFrame:
    """row, doc_id long, same (key of equal words), n (words), keys array<long> (a bucket for each band and weighting; equal ones once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for whole in batches:
            for b in _blocks(whole):
                h, row = shingles(b.column("words"))
                ln_w = table[(h & np.uint64(TABLE - 1)).astype(np.int64)]
                els = elements(h, row)
                weighted = _keys(samples(els, row, ln_w, b.num_rows, bands * rows_), bands, rows_)
                plain = weighted.copy()  # as it is for documents without common shingles
                common = np.zeros(b.num_rows, bool)
                common[row[ln_w < 0]] = True
                if common.any():
                    at = common[row]
                    plain[common] = _keys(samples(els[at], row[at], np.zeros(int(at.sum()), np.float32), b.num_rows, bands * rows_)[common], bands, rows_)
                keys, keep = np.hstack([weighted, plain]), np.hstack([np.ones(weighted.shape, bool), plain != weighted])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]), pa.int32()), pa.array(keys[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("same"), b.column("words").value_lengths(), lists], ["row", "doc_id", "same", "n", "keys"])

    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words"))
    slim = words.select("row", "doc_id", "words", same_words(F.col("words")).alias("same"))
    return slim.mapInArrow(run, "row long, doc_id long, same string, n int, keys array<long>")


def _elements_of(docs: DataFrame, wanted: DataFrame, idf: object) -> DataFrame:
    """doc, els (binary, 64-bit little-endian), weights (binary, 32-bit, null where all are 1) of the wanted texts (doc, first, same): of the row of the first id, or any of its equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for whole in batches:
            for b in _blocks(whole):
                h, row = shingles(b.column("words"))
                ln_w = table[(h & np.uint64(TABLE - 1)).astype(np.int64)]
                els, cuts = elements(h, row).astype("<u8"), np.searchsorted(row, np.arange(b.num_rows + 1))
                own = [slice(cuts[i], cuts[i + 1]) for i in range(b.num_rows)]
                weights = [np.exp(ln_w[k]).astype("<f4").tobytes() if (ln_w[k] < 0).any() else None for k in own]
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([els[k].tobytes() for k in own], pa.binary()), pa.array(weights, pa.binary())], ["doc", "els", "weights"])

    # the same join at every size: wanted grows with the input, so it is never broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", same_words(word_hashes(F.col("text"))).alias("key"))
    rows = rows.join(wanted.hint("merge"), F.col("key").eqNullSafe(F.col("same")) & F.col("id").eqNullSafe(F.col("first")))
    return rows.select("doc", word_hashes(F.col("text")).alias("words")).mapInArrow(run, "doc long, els binary, weights binary")


def prefixes(els: np.ndarray, weights: np.ndarray | None, df: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """A text's rarest elements, rarest first, and how many of them seek.

    Of two texts that are alike, by either weighting, the rarest element that
    both have is among these of either, and seeks in one of them (the lighter):
    from it on, that one still has 2 t / (1 + t) of its weight, as both share so much.
    """
    order = np.lexsort((els, df[(els & np.uint64(TABLE - 1)).astype(np.int64)]))
    least = 2 * threshold / (1 + threshold)
    n, seeks = (int(len(els) * (1 - x) + 1e-9) + 1 for x in (threshold, least))
    if weights is not None:
        w = weights[order].astype(np.float64)
        left = w.sum() - np.cumsum(w) + w  # of an element and those after it
        n, seeks = (max(k, int((left >= x * w.sum() - 1e-6).sum())) for k, x in ((n, threshold), (seeks, least)))
    return els[order[:n]], seeks


def rarest(els: np.ndarray, weights: np.ndarray | None, df: np.ndarray, threshold: float) -> np.ndarray:
    """A text's rarest elements, of which any text that is alike by either weighting shares one."""
    return prefixes(els, weights, df, threshold)[0]


def _rare_elements(els: DataFrame, df: object, threshold: float) -> DataFrame:
    """doc, label, key (element), df (documents of its slot), words (elements of the text), seeks of the rarest elements of texts (doc, label, els, weights). By (df, key) elements are in the order of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [np.frombuffer(x, "<u8") for x in b.column("els").to_pylist()]
                own = [prefixes(x, None if w is None else np.frombuffer(w, "<f4"), df.value, threshold) for x, w in zip(sets, b.column("weights").to_pylist(), strict=True)]
                n, words = [len(x) for x, _ in own], np.array([len(x) for x in sets], np.int64)
                keys = np.concatenate([x for x, _ in own]) if own else np.zeros(0, np.uint64)
                columns = [
                    np.repeat(b.column("doc").to_numpy(), n), np.repeat(b.column("label").to_numpy(), n), (keys ^ np.uint64(1 << 63)).view(np.int64), df.value[(keys & np.uint64(TABLE - 1)).astype(np.int64)],
                    np.repeat(words, n), np.concatenate([np.arange(len(x)) < k for x, k in own]) if own else np.zeros(0, bool),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "label", "key", "df", "words", "seeks"])

    return els.where("length(els) > 0").select("doc", "label", "els", "weights").mapInArrow(run, "doc long, label long, key long, df float, words long, seeks boolean")


def _second_look(members: DataFrame, labels: DataFrame, els: DataFrame, df: object, threshold: float, chunk: int) -> DataFrame | None:
    """doc, label, groups of the texts of large buckets that rare elements bring together again; None where no bucket is large."""
    crowded = written(members.where("chunks > 1").select("doc").distinct().join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc")))
    if not crowded.limit(1).count():
        return None
    rare = written(_rare_elements(els.join(crowded, "doc"), df, threshold))
    parts = rare.groupBy("key", "df", "label").agg(F.count("*").alias("own"), F.sum("words").alias("words"), F.count_if("seeks").alias("seekers"), F.bit_xor(F.xxhash64("doc")).alias("all"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("all2"))
    met = parts.groupBy("key", "df").agg(
        F.sum("own").alias("n"), F.sum("words").alias("words"), F.sum("seekers").alias("seekers"), F.count("*").alias("labels"), F.bit_xor("all").alias("all"), F.bit_xor("all2").alias("all2"), F.max_by("label", F.struct("own", "label")).alias("major"), F.max("own").alias("most"),
    ).where("labels > 1 AND seekers > 0")
    # of those with the same texts the rarest is enough: who seeks by a later one seeks by it
    met = met.groupBy("n", "words", "all", "all2").agg(F.min(F.struct("df", "key", "seekers", "major", "most")).alias("x")).select("n", "words", "x.*")
    # of two texts to compare one seeks and one is outside the largest component: the fewer of these meet all
    few = F.least("seekers", F.col("n") - F.col("most"))
    chunks = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("words") / CHUNK_WORDS)).cast("long")
    met = met.select("key", "major", (F.col("seekers") <= F.col("n") - F.col("most")).alias("by_seekers"), chunks.alias("chunks"), F.ceil(few / chunk).cast("long").alias("parts"))
    rows = spread_join(rare, met, ["key"], F.col("doc")).withColumn("few", F.when(F.col("by_seekers"), F.col("seeks")).otherwise(F.col("label") != F.col("major")))
    place, part = F.pmod(F.xxhash64("key", "doc"), F.col("chunks")), F.pmod(F.xxhash64(F.lit(2), "key", "doc"), F.col("parts"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    group = lambda at, of: F.xxhash64("key", at, of)
    all_ = F.transform(upto("parts"), lambda x: group(place, x))
    sought = F.when(F.col("few"), F.transform(upto("chunks"), lambda x: group(x, part))).otherwise(F.array().cast("array<long>"))
    return rows.groupBy("doc", "label").agg(F.flatten(F.collect_list(F.array_union(all_, sought))).alias("groups"))


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, same) and the classes of texts (same, class_id, kept: the number of the row that stands for the class)."""
    sc = docs.sparkSession.sparkContext
    counts = slot_counts(docs)
    idf, df = sc.broadcast(ln_idf(counts, docs.count())), sc.broadcast(counts.astype(np.float32))  # TABLE numbers each
    sampled = written(_sampled(docs, idf, bands, rows))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    texts = written(sampled.groupBy("same").agg(least, F.any_value("n").alias("n"), F.any_value("keys").alias("keys")).withColumn("rep", F.monotonically_increasing_id()))

    # buckets of two or more; of those with the same texts one is enough
    each = texts.select("rep", "n", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.bit_xor(F.xxhash64("rep")).alias("all"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("all2")).where("n > 1")
    sizes = sizes.groupBy("n", "words", "all", "all2").agg(F.min("key").alias("key"))
    chunks = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("words") / CHUNK_WORDS)).cast("long")
    members = written(each.drop("n").join(sizes.select("key", chunks.alias("chunks")), "key").select(F.col("rep").alias("doc"), "key", "chunks"))
    wanted = members.select("doc").distinct().join(texts.select(F.col("rep").alias("doc"), F.col("least.doc_id").alias("first"), "same"), "doc")
    els = written(_elements_of(docs, wanted, idf).dropDuplicates(["doc"]))  # equal ones

    place = F.pmod(F.xxhash64("key", "doc"), F.col("chunks"))
    first = members.select(F.xxhash64("key", place).alias("group"), "doc", F.col("doc").alias("label")).join(els, "doc")
    edges = written(_linked(first, threshold))
    labels = components(edges)

    again = _second_look(members, labels, els, df, threshold, chunk)
    if again is not None:
        met = again.join(els, "doc").select(F.explode("groups").alias("group"), "doc", "label", "els", "weights")
        edges = edges.unionByName(written(_linked(met, threshold)))
        labels = components(edges)

    labelled = texts.select("same", "rep", "least").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = written(labelled)
    named = labelled.groupBy("label").agg(F.min("least").alias("least")).select("label", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("kept"))
    return sampled.select("row", "doc_id", "same"), spread_join(labelled.select("same", "label"), named, ["label"], F.col("same")).drop("label")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), one row per row of docs."""
    own, classes = _classes(docs, threshold, bands, rows, chunk)
    return spread_join(own, classes, ["same"], F.col("row")).select("doc_id", "class_id")


def first_of_classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row of docs for each class, that of its smallest id (rows without an id come last, then the first read), with all its columns.

    docs must give its rows in the same order each time it is read, as files do.
    """
    _, classes = _classes(docs, threshold, bands, rows, chunk)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = classes.select(F.col("kept").alias("row")).distinct()
    return docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()).join(kept, "row", "left_semi").drop("row").toDF(*docs.columns)
