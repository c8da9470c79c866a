"""Product codes, whitening and SimHash against plain versions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import partial, queries, simhash, whiten
from lodestone.llm.common import table
from tests.llm.conftest import CLASH, SF
from tests.oracle_util import connection, same

VECTORS = "vec_id long, embedding array<float>, label int"


def kept(rows):
    return [(i, [float(np.float32(c)) for c in v], label) for i, v, label in rows if v and all(c is not None and np.isfinite(c) for c in v)]


# --- codes ----------------------------------------------------------------


def plain_codes(rows):
    rows = kept(rows)
    x = np.floor(1024 * np.array([v for _, v, _ in rows])).astype(np.int64)
    ids = sorted({i for i, _, _ in rows if i is not None}) + [None] * any(i is None for i, _, _ in rows)
    seeds = np.array([min(x[k].tolist() for k, r in enumerate(rows) if r[0] == i) for i in ids[:256]])
    cuts = np.array_split(np.arange(x.shape[1]), 4)
    books = [seeds[:, c] for c in cuts]

    def assign():
        all_ = [((x[:, None, c] - b[None]) ** 2).sum(2) for c, b in zip(cuts, books, strict=True)]
        return [d.argmin(1) for d in all_], sum(d.min(1) for d in all_)

    for _ in range(4):
        codes, _ = assign()
        books = [np.array([x[code == e][:, c].sum(0) // (code == e).sum() if (code == e).any() else b[e] for e in range(len(b))]) for code, b, c in zip(codes, books, cuts, strict=True)]
    codes, error = assign()
    by = {}
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c[k]:02x}" for c in codes), e, by[label], sha) for k, ((i, _, label), e) in enumerate(zip(rows, error.tolist(), strict=True)))


def hard_vectors(n=300, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in rng.normal(size=d).astype(np.float32).round(1)], int(i) % 3 if i % 7 else None) for i in rng.permutation(n)]
    zero = [0.0] * d
    return [*rows, *rows[:3], (None, zero, 1), (None, zero, 1), (n, None, 1), (n + 1, [*zero[1:], None], 1), (n + 2, [float("nan"), *zero[1:]], 1), (n + 3, [float("inf"), *zero[1:]], None), (n + 4, [], 2), (n + 5, zero, None), (n + 6, zero, None)]


def codes_of(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n", [10, 400])
def test_codes(spark, n):
    rows = hard_vectors(n)
    df = spark.createDataFrame(rows, VECTORS)
    assert codes_of(partial.codes(df)) == plain_codes(rows)
    assert codes_of(partial.codes(df.withColumns({c: df.vec_id for c in CLASH if c != "label"}).repartition(5))) == plain_codes(rows)


def test_codes_of_nothing(spark):
    assert partial.codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert partial.codes(spark.createDataFrame([(1, None, 1), (2, [None], 1)], VECTORS)).count() == 0


def test_codes_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError):
        partial.codes(spark.createDataFrame([(1, [3e6] * 8, 1), (2, [-3e6] * 8, 1)], VECTORS))
    with pytest.raises(Exception, match="beyond 2"):
        partial.codes(spark.createDataFrame([(1, [3e38] * 8, 1)], VECTORS))


def test_codes_sql(spark):
    same(queries.QUERIES["op11_codes"](spark, SF), connection(SF), queries.ORACLE_SQL["op11_codes"])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 12), st.integers(0, 99))
def test_nearest(n, k, d, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-3, 4, (n, d)), rng.integers(-3, 4, (k, d))
    entry, distance = partial.nearest(x, book)
    all_ = ((x[:, None] - book[None]) ** 2).sum(2)
    assert entry.tolist() == all_.argmin(1).tolist() and distance.tolist() == all_.min(1).tolist()


def test_search_drops_most_entries():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (500, 16)) * (1 + 20 * (np.arange(16) == 9))
    book = x[:256]
    order = np.argsort(-book.var(axis=0))
    assert order[0] == 9
    entry, _ = partial.nearest(x, book)
    assert entry[:256].tolist() == list(range(256))


# --- whitening ------------------------------------------------------------


def plain_whitened(rows, components=32):
    rows = kept(rows)
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    off = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x.tolist()]
    centred = x - s / n
    v = centred.T @ centred / n
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    return n, off, centred @ vectors / np.sqrt(np.where(e > 0, e, 1)), e / np.trace(v), [i for i, _, _ in rows]


@pytest.mark.parametrize("tile", [3, 32])
def test_whitened(spark, tile):
    rows = [r for r in hard_vectors(200, 8) if r[0] is not None]
    n, off, w, share, ids = plain_whitened(rows)
    got = whiten.whitened(spark.createDataFrame(rows, VECTORS).repartition(6), tile=tile).collect()
    assert len(got) == n * 8 and {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-9
    want = {}
    for i, o, row in zip(ids, off, w.tolist(), strict=True):
        want.setdefault(i, []).append((o, row))
    sign = {}
    for r in got:
        o, row = want[r.vec_id][0]
        value = row[r.component - 1]
        if abs(value) > 1e-6:
            assert sign.setdefault(r.component, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
        assert r.deviation == o and abs(abs(r.whitened) - abs(value)) < 1e-8 and abs(r.explained - share[r.component - 1]) < 1e-9


def test_whitened_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    n, off, w, share, ids = plain_whitened(rows)
    at = {i: k for k, i in enumerate(ids)}
    got = queries.QUERIES["op12_whitened"](spark, SF).collect()
    assert len(got) == n * 32
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        assert r.deviation == off[k] and abs(abs(r.whitened) - abs(w[k, c])) < 1e-7 and abs(r.explained - share[c]) < 1e-4 * share[c] and r.identity_error < 1e-4


def test_whitened_of_little(spark):
    assert whiten.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    got = whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    two = whiten.whitened(spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1)], VECTORS)).orderBy("vec_id", "component").collect()
    assert [round(abs(r.whitened), 9) for r in two] == [1, 0, 1, 0] and round(two[0].explained, 9) == 1 and two[0].identity_error < 1e-9


# --- SimHash --------------------------------------------------------------


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints, budget=3):
    """The smallest position that each print reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def plain_classes(rows):
    prints = [plain_print(t) for _, t in rows]
    root = joined(prints)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return sorted((str(i), f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True))


def classes_of(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


@pytest.mark.parametrize("most", [2, 4096])
def test_classes(spark, hard, clashing, most):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert classes_of(simhash.classes(hard, most=most)) == plain_classes(rows)
    assert classes_of(simhash.classes(clashing, most=most)) == plain_classes(rows)


def test_classes_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert classes_of(queries.QUERIES["op13_simhash"](spark, SF)) == plain_classes(rows)


def test_classes_of_nothing(spark, none):
    assert simhash.classes(none).count() == 0
    got = simhash.classes(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, "0" * 16, None)] * 2


@pytest.mark.parametrize("most", [3, 40])
def test_links_of_crowded_tries(spark, most):
    """Keys around a few centres: every cut is hot, and links run across all chunks."""
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 6, dtype=np.uint64)[rng.integers(0, 6, 600)]
    for _ in range(4):
        keys = keys ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    keys = np.unique(keys)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, most=most).collect()]
    at = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in got)
    root = list(range(len(keys)))
    for a, b in got:
        x, y = at[a], at[b]
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    find = lambda i: i if root[i] == i else find(root[i])
    assert [find(i) for i in range(len(keys))] == joined([int(k) for k in keys])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 10), st.integers(0, 3), st.integers(0, 99))
def test_trie_links(n, spread, budget, seed):
    rng = np.random.default_rng(seed)
    keys, group = np.unique(rng.integers(0, 1 << spread, n, dtype=np.uint64) << np.uint64(50)), None
    group = np.zeros(len(keys), np.int64)
    a, b = simhash.trie_links(keys, group, budget)
    root = list(range(len(keys)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        assert x != y
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(keys))] == joined([int(k) for k in keys], budget)
