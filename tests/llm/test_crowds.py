"""Near-duplicates in buckets that many unlike texts share."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import neardup
from tests.llm import brute


def licence(n, seed=0, own=60):
    """A passage of 120 words in every text, and words of its own; every seventh is a near copy of the one before."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(10**9)}" for _ in range(own)]
        if i % 7 == 6:
            words = rows[-1][1].split()[120:]
            words[rng.randrange(own)] = "changed"
        rows.append((i, f"{passage} {' '.join(words)}"))
    return rows


def test_classes_in_a_crowd(spark):
    rows = licence(600)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, chunk=32).collect()}
    assert got == brute.near_classes(dict(rows))
    assert len(set(got.values())) == 600 - 85


def test_comparisons_grow_with_texts(spark, monkeypatch):
    """Texts that share no more than a passage don't meet again, however many they are."""
    seen = []
    look = neardup._second_look
    monkeypatch.setattr(neardup, "_second_look", lambda *a: seen.append(look(*a)) or seen[-1])
    for n in (400, 800):
        df = spark.createDataFrame([r for r in licence(n) if r[0] % 7 != 6], "doc_id long, text string")
        assert neardup.near_duplicates(df, chunk=32).select("class_id").distinct().count() == df.count()
    rows = [x.count() for x in seen if x is not None]
    assert len(rows) == 2 and max(rows) <= 100


@pytest.mark.parametrize("weighted", [False, True])
@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 999))
def test_alike_texts_share_a_rare_element(weighted, common, a, b, seed):
    rng = np.random.default_rng(seed)
    df = rng.integers(1, 9, neardup.TABLE)
    all_ = rng.integers(0, 1 << 62, common + a + b, dtype=np.uint64)
    x, y = all_[: common + a], np.concatenate([all_[:common], all_[common + a :]])
    weight = dict(zip(all_.tolist(), rng.choice([1.0, 0.5, 0.05], len(all_)).astype(np.float32).tolist(), strict=True))
    w = lambda s: np.array([weight[e] for e in s.tolist()], np.float32) if weighted else None
    of = lambda s: float(sum(weight[e] if weighted else 1 for e in s.tolist()))
    alike = of(all_[:common]) >= 0.8 * (of(x) + of(y) - of(all_[:common]))
    shared = set(neardup.rarest(x, w(x), df, 0.8).tolist()) & set(neardup.rarest(y, w(y), df, 0.8).tolist())
    assert shared or not alike


def edited(n, seed=1, words=120):
    """Near copies of one text: a few words of each are its own, so that the tenth that differs least is alike."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"p{k}" for k in range(words)]
        for k in rng.sample(range(words), 3 + i % 2 if i % 10 else 1):
            own[k] = f"w{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    return rows


def test_near_copies_meet_few_times(spark, monkeypatch):
    """Texts that differ too much to seek by an element are not dealt to every part of its group."""
    rows, seen = edited(400), []
    linked = neardup._linked
    monkeypatch.setattr(neardup, "_linked", lambda met, t: seen.append(met.count()) or linked(met, t))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, chunk=32).collect()}
    assert got == brute.near_classes(dict(rows))
    assert len(seen) == 2 and seen[1] < 12_000


@pytest.mark.parametrize("weighted", [False, True])
@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 999))
def test_one_of_alike_texts_seeks(weighted, common, a, b, seed):
    rng = np.random.default_rng(seed)
    df = rng.integers(1, 9, neardup.TABLE)
    all_ = rng.integers(0, 1 << 62, common + a + b, dtype=np.uint64)
    x, y = all_[: common + a], np.concatenate([all_[:common], all_[common + a :]])
    weight = dict(zip(all_.tolist(), rng.choice([1.0, 0.5, 0.05], len(all_)).astype(np.float32).tolist(), strict=True))
    w = lambda s: np.array([weight[e] for e in s.tolist()], np.float32) if weighted else None
    of = lambda s: float(sum(weight[e] if weighted else 1 for e in s.tolist()))
    if of(all_[:common]) >= 0.8 * (of(x) + of(y) - of(all_[:common])):
        first = min(all_[:common].tolist(), key=lambda e: (df[e & (neardup.TABLE - 1)], e))
        (p, k), (q, m) = neardup.prefixes(x, w(x), df, 0.8), neardup.prefixes(y, w(y), df, 0.8)
        assert first in p and first in q and (first in p[:k] or first in q[:m])
