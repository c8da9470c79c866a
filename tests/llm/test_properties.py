"""Properties of the helpers that run on the driver or inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import mixing, packing

@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 500), min_size=1), st.integers(1, 40), st.integers(0, 9))
@settings(max_examples=100, deadline=None)
def test_splitting_tree(blocks, shards, seed):
    got = {name: [] for name in blocks}
    quotas = mixing.even_quotas(sum(blocks.values()), shards)
    for name, shard, first, end in mixing.split_blocks(blocks, quotas, seed):
        assert 0 <= shard < shards and first < end
        got[name] += range(first, end)
    assert all(sorted(v) == list(range(blocks[k])) for k, v in got.items())


@given(st.lists(st.tuples(st.lists(st.integers(1, 400), min_size=1, max_size=8), st.floats(0.1, 9)), min_size=1, max_size=5), st.integers(8, 64))
@settings(max_examples=200, deadline=None)
def test_schedule_covers_every_token_once(sources, length):
    sizes = [np.array(x) for x, _ in sources]
    plan = packing.Schedule([int(x.sum()) for x in sizes], [w for _, w in sources], length)
    queue = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
    n, start = np.concatenate(sizes), np.concatenate([np.cumsum(x) - x for x in sizes])
    doc, begin, k, _, place = plan.pieces(queue, start, n)
    assert (k > 0).all() and (place // length == (place + k - 1) // length).all()
    assert sorted(x for a, b in zip(place.tolist(), k.tolist(), strict=True) for x in range(a, a + b)) == list(range(int(n.sum())))
    for d in range(len(n)):
        own = doc == d
        assert sorted(x for a, b in zip(begin[own].tolist(), k[own].tolist(), strict=True) for x in range(a, a + b)) == list(range(int(n[d])))


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_word_ids_equal_whole_encoding(text):
    known = packing.word_ids(packing.default_tokenizer())
    assert known.ids(text) == known.whole(text.encode("utf-8", "replace").decode()) + b"\x02\x00"


def test_words_that_come_once_are_not_kept(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    known = packing.WordIds(packing.default_tokenizer())
    once = " ".join(f"{a}{b}q" for a in "abcdefgh" for b in "ijklmnop")
    known.ids(once)
    assert len(known) <= 5
    for text in (once, once, "the of, and. the " * 3 + once, once + " the of, and."):  # words turn old, come again and go
        assert known.ids(text) == known.whole(text) + b"\x02\x00"
        assert len(known) <= 50 and len(known.older) <= 50


def test_packing_holds_few_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plain, steps = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda d, f, schema: steps.append(f) or plain(d, f, schema))
    packing.tokenized(docs)
    n = 3 * packing.HELD + 7
    rows = pa.RecordBatch.from_pydict({"row": range(n), "doc_id": range(n), "source": ["s"] * n, "place": pa.nulls(n, pa.string()), "text": [f"some text {i}" for i in range(n)]})
    got = list(steps[0](iter([rows])))
    assert max(b.num_rows for b in got) == packing.HELD and [x for b in got for x in b.column("row").to_pylist()] == list(range(n))


def test_more_blocks_than_a_draw_holds():
    blocks = {"a": 17_000_000_000, "b": 12_000_000_001, "c": 999_999_999, "d": 3, "e": 0}
    quotas = mixing.even_quotas(sum(blocks.values()), 64)
    got = list(mixing.split_blocks(blocks, quotas, 5))
    assert got == list(mixing.split_blocks(blocks, quotas, 5))
    per = np.zeros(64, np.int64)
    for source, n in blocks.items():
        at = 0
        for first, end in sorted((f, e) for k, _, f, e in got if k == source):
            assert first == at and end > first
            at = end
        assert at == n
    for _, shard, first, end in got:
        per[shard] += end - first
    assert per.tolist() == quotas.tolist()
    share = {k: [0] * 64 for k in blocks}
    for k, shard, first, end in got:
        share[k][shard] += end - first
    assert all(abs(x * 64 / blocks["a"] - 1) < 0.01 for x in share["a"])


def test_a_rare_source_in_a_long_stream():
    """One document of ten tokens beside 2 * 10^11 tokens in 200 queues: work follows the document."""
    import time
    import tracemalloc

    tokens = [10**9] * 200 + [10, 5000, 1]
    plan = packing.Schedule(tokens, [float(t) for t in tokens], 4096)
    tracemalloc.start()
    began = time.time()
    queue, start, size = np.array([200, 201, 202, 7]), np.array([0, 1000, 0, 123_456_789]), np.array([10, 1000, 1, 4000])
    doc, begin, length, window, place = plan.pieces(queue, start, size)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 1 and peak < 100_000_000
    for d in range(4):
        own = np.argsort(begin[doc == d])
        b, n = begin[doc == d][own], length[doc == d][own]
        assert b[0] == 0 and (b[1:] == (b + n)[:-1]).all() and n.sum() == size[d]
    assert (doc == 0).sum() <= 2 and (doc == 1).sum() <= 1000 // 32 + 3  # pieces of 32 tokens, but for cuts of sequences


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 4000), min_size=1, max_size=30), st.integers(0, 99))
def test_small_quanta_fill_the_stream(sizes, seed):
    """Queues of quanta below the least piece: every token has one place, and spending stays near the share."""
    rng = np.random.default_rng(seed)
    tokens = [20_000, *sizes]
    plan = packing.Schedule(tokens, [float(t) for t in tokens], 2048)
    queue = np.repeat(np.arange(len(tokens)), 1)
    doc, begin, length, window, place = plan.pieces(queue, np.zeros(len(tokens), np.int64), np.array(tokens))
    covered = np.zeros(sum(tokens), np.int64)
    for p, n in zip(place.tolist(), length.tolist(), strict=True):
        covered[p : p + n] += 1
    assert (covered == 1).all()
    n = (sum(tokens) - 1) // 2048
    some = rng.integers(0, n + 1, 5)
    spent = plan.spent(some)
    due = np.array(tokens) / sum(tokens) * np.minimum((some[:, None] + 1) * 2048, sum(tokens))
    assert (np.abs(spent - due) <= plan.least + 1).all() and plan.least == 16
