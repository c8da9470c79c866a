"""SimHash fingerprints linked by a self-join of binary tries.

A document's features are the hashes (XXH64, seed 42) of its three-word
shingles, repeats included; a fingerprint's bit is 1 where over half of the
hashes have it. Fingerprints of at most ``budget`` differing bits link, and
connected components of the links are the classes.

1. Equal fingerprints are one key, so copies are never paired.
2. Of budget + 1 chunks of a fingerprint's bits two linked ones share at least
   one. So each key goes to one trie per chunk, that of the keys which agree on
   it: the trie's errors on those levels are zero, its budget holds below them.
   A trie of over MOST keys is cut again in the same way by the bits that are
   still free; after five cuts a trie has at most 2^16 keys, whatever the table.
3. Tries are joined with themselves: pairs of nodes are walked down together,
   the bits in which their common levels differ are added up, and a pair beyond
   the budget is dropped with all that is below it. So is a pair of nodes whose
   keys are all joined already; no group is expanded into its pairs, and a trie
   returns fewer links than it has keys.

Edge cases: null, empty and blank texts have the fingerprint zero, which links
like any other. A text of one or two words is one shingle. Rows that repeat or
share an id are each returned; a row without an id gets the class of its
fingerprint and names none (component_id is null where no row of a class has an
id). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import spread_join, written
from lodestone.llm.neardup import components

SHINGLE = 3
BUDGET = 3
BITS = 64
#: Keys of a trie; with FREE bits or fewer it has at most 2^FREE and isn't cut again.
MOST = 4096
FREE = 16
SEED = 42
#: Node pairs that a walk takes at a time; rows of whole tries that a task holds.
PAIRS = 1 << 17
HELD = 100_000


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the ASCII white space
    if not words:
        return 0
    plain, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), "<u8", len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PAIRS):
        ones += np.unpackbits(hashes[at : at + PAIRS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id long, fp long (the fingerprint's bits), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Tries:
    """Path-compressed binary tries of the groups of sorted keys; nodes below len(keys) are leaves.

    ``low`` has the bits at and under a node's branch, none for a leaf; the
    others are the same for all its keys, of which ``first`` is one.
    """

    def __init__(self, keys: np.ndarray, group: np.ndarray) -> None:
        n = len(keys)
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, np.int64)
        lo, hi = cuts[:-1], cuts[1:]
        self.n, inner = n, n
        los, his, lows, lefts, rights = ([x] for x in (np.arange(n), np.arange(1, n + 1), np.zeros(n, np.uint64), np.full(n, -1), np.full(n, -1)))
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        self.roots = inner + np.arange(len(lo))
        while len(lo):
            low = keys[lo] ^ keys[hi - 1]
            for k in (1, 2, 4, 8, 16, 32):
                low |= low >> np.uint64(k)
            turn = keys[hi - 1] & ~(low >> np.uint64(1))  # the least key beyond the branch
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                under = open_ & (keys[np.minimum(mid, n - 1)] < turn)
                a, b = np.where(under, mid + 1, a), np.where(open_ & ~under, mid, b)
            inner += len(lo)
            ends = np.stack([np.stack([lo, a]), np.stack([a, hi])], axis=1)  # child, (from, to)
            wide = ends[1] - ends[0] > 1
            names = np.where(wide, inner + np.cumsum(wide.ravel()).reshape(wide.shape) - 1, ends[0])
            for all_, x in zip((los, his, lows, lefts, rights), (lo, hi, low, names[0], names[1]), strict=True):
                all_.append(x)
            lo, hi = ends[0][wide], ends[1][wide]
        self.lo, self.hi, self.low, self.left, self.right = map(np.concatenate, (los, his, lows, lefts, rights))
        self.first = keys[self.lo]


def trie_links(keys: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of linked keys, such that the links' components are those of all pairs of a group with at most budget differing bits; keys ascend in each group and differ."""
    t = Tries(keys, group)
    parent = np.arange(t.n)
    change = np.arange(t.n)  # equal over a node's keys where they are all joined

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    stack = [(t.roots, t.roots)]
    while stack:
        a, b = stack.pop()
        if len(a) > PAIRS:
            stack.append((a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        joined = (parent[t.lo[a]] == parent[t.lo[b]]) & (change[t.lo[a]] == change[t.hi[a] - 1]) & (change[t.lo[b]] == change[t.hi[b] - 1])
        low = np.maximum(t.low[a], t.low[b])
        differing = np.bitwise_count((t.first[a] ^ t.first[b]) & ~low)
        near = ~joined & ((differing <= budget) | (a == b))
        a, b, low = a[near], b[near], low[near]
        leaves = low == 0
        apart = leaves.copy()
        apart[leaves] = parent[a[leaves]] != parent[b[leaves]]
        more = False
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
                more = True
        if more:
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            change = np.cumsum(np.concatenate([[0], parent[1:] != parent[:-1]]))
        a, b = a[~leaves], b[~leaves]
        own = a == b
        c, (a, b) = a[own], (a[~own], b[~own])
        swap = t.low[a] < t.low[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)  # the higher branch goes down
        stack.append((np.concatenate([t.left[a], t.right[a], t.left[c]]), np.concatenate([b, b, t.right[c]])))
        stack.append((np.concatenate([t.left[c], t.right[c]]),) * 2)
        stack = [x for x in stack if len(x[0])]
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def narrower(mask: int, budget: int) -> list[int]:
    """mask with one of budget + 1 nearly equal chunks of its free bits added, for each chunk."""
    free = [i for i in reversed(range(BITS)) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in chunk) for chunk in np.array_split(free, budget + 1) if len(chunk)]


def _joined(rows: DataFrame, budget: int) -> DataFrame:
    """Links a, b of rows (mask, key, fp), whose groups (mask, key) each fit into a task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("mask", "key", "fp").repartition(n, "mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            begins = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])[: len(fp)]
            group, keys = np.cumsum(begins), fp.view(np.uint64)
            by = np.lexsort((keys, group))
            again = (group[by[1:]] == group[by[:-1]]) & (keys[by[1:]] == keys[by[:-1]])  # two ways of cutting can end in one mask
            by = by[np.concatenate([[True], ~again])[: len(by)]]
            a, b = trie_links(keys[by], group[by], budget)
            return pa.RecordBatch.from_arrays([pa.array(fp[by][a]), pa.array(fp[by][b])], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("mask", "key", "fp"), strict=True)]
            mask, key, _ = held
            earlier = np.flatnonzero((mask != mask[-1]) | (key != key[-1])) if len(key) >= HELD else []
            if len(earlier):  # all groups but the last are whole
                yield links(*(x[: earlier[-1] + 1] for x in held))
                held = [x[earlier[-1] + 1 :] for x in held]
        yield links(*held)

    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """Links a, b of the distinct fingerprints fp. Runs an action for each cut of the tries."""
    spark = prints.sparkSession
    rows, masks, found = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    while True:
        cuts = [(_signed(m), _signed(c)) for m in masks for c in narrower(m, budget)]
        masks = sorted({c for m in masks for c in narrower(m, budget)})
        below = F.broadcast(spark.createDataFrame(cuts, "mask long, cut long"))  # 4 to 1024 rows
        rows = rows.join(below, "mask").select("fp", F.col("cut").alias("mask"), F.col("fp").bitwiseAND(F.col("cut")).alias("key"))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = written(spread_join(rows, sizes, ["mask", "key"], F.col("fp")))
        large = rows.where(F.col("n") > most)
        if max(BITS - m.bit_count() for m in masks) <= FREE or not large.limit(1).count():
            found.append(written(_joined(rows, budget)))
            break
        found.append(written(_joined(rows.where(F.col("n") <= most), budget)))
        rows = large
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def classes(docs: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the class), one row per row of docs."""
    rows = written(fingerprints(docs))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(prints, budget, most)).withColumnRenamed("id", "fp")
    labelled = written(prints.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = spread_join(labelled.select("fp", "label"), named, ["label"], F.col("fp")).drop("label")
    return spread_join(rows, found, ["fp"], F.monotonically_increasing_id()).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
