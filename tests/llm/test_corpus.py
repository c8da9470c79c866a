"""Near-duplicates, mixing, packing and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, neardup, packing, queries, secrets, toxicity
from tests.llm import brute
from tests.llm.conftest import SF


def classes(df, **params):
    return {r.doc_id: r.class_id for r in neardup.near_duplicates(df, **params).collect()}


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = [t for t in texts.values() if 60 < len(t.split()) < 400][:12]
    for k in range(150):  # near copies with a few words changed, and chains of them
        ws = rng.choice(base if k % 3 else list(texts.values())[-20:]).split()
        for _ in range(rng.randint(0, max(1, len(ws) // 40))):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(9999)}"
        texts[10_000 + k] = " ".join(ws)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.near_classes(texts)
    assert len(set(want.values())) < len(want) - 40
    assert classes(df) == want
    assert classes(df, chunk=8) == want  # large buckets are dealt into chunks and still come out whole


def test_copies_of_common_passages_are_found(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    passages = [words(f"p{i}x", 100) for i in range(12)]
    texts = {i: " ".join([*passages, words(f"long{i}x", 1500)]) for i in range(60)}
    texts |= {100 + i: words(f"else{i}x", 50) for i in range(20)}
    texts |= {200 + 2 * i + k: f"{p} {words(f'own{i}x{k}x', 11)}" for i, p in enumerate(passages) for k in range(2)}
    want = brute.near_classes(texts)
    assert all(want[201 + 2 * i] == 200 + 2 * i for i in range(12)) and len(set(want.values())) == 92
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert classes(df) == want


def test_samples_do_not_depend_on_the_batch():
    h, row = np.arange(1, 41, dtype=np.uint64) * neardup._P, np.repeat([0, 1], 20)
    ln_w = np.where(row == 1, np.float32(-1), np.float32(0))
    both, one = neardup.samples(h, row, ln_w, 2, 8), neardup.samples(h[:20], row[:20], ln_w[:20], 1, 8)
    assert both[0].tolist() == one[0].tolist()


def test_near_duplicates_of_hard_rows(spark, hard, none, clashing):
    got = classes(hard)
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, None: None} and classes(clashing) == got and classes(none) == {}
    assert neardup.near_duplicates(hard).count() == hard.count()


def test_rows_that_share_an_id_or_have_none(spark, docs):
    words = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("b") + " x"), (None, words("c")), (None, words("c") + " y"), (None, words("d")), (7, words("d"))]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], docs.schema)
    got = Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(1, 1): 3, (2, 1): 1, (None, None): 2, (None, 7): 1, (7, 7): 1})
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, df, SF).collect()}
    assert kept == {(1, words("a")), (1, words("b")), (None, words("c")), (7, words("d"))}
    lost = Counter((r.doc_id, r.text) for r in df.collect()) - Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, df, SF).collect())
    assert not lost


def test_many_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words in every one of them all").alias("text"))
    assert set(classes(df).values()) == {0}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    weight = dict(zip(np.concatenate([a, b]).tolist(), np.log(rng.uniform(0.1, 1, 800)).astype(np.float32), strict=True))
    h, row = np.concatenate([a, b]), np.repeat([0, 1], 400)
    ln_w = np.array([weight[int(x)] for x in h], np.float32)
    s = neardup.samples(h, row, ln_w, 2, 2000)
    w = np.exp(ln_w)
    inter = w[:300].sum()
    assert abs((s[0] == s[1]).mean() - inter / (w.sum() - inter)) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def check_mix(rows, docs):
    want = brute.mix_targets(docs)
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r["size"] and (r["size"] == 0) == (r.taken == 0 and r["size"] == 0)
        taken[round(r.target, 6), r.source_size] += r.taken
    groups = Counter((round(t, 6), s) for s, t in want.values())
    largest = max((len(brute.words(t)) for _, t in docs), default=0)
    for (target, size), n in groups.items():
        assert abs(taken[target, size] - n * target) <= n * max(0.03 * target, largest / 2 if size < 2000 else 0, 1), (target, size, taken[target, size])


def test_mixing(spark, docs, hard, none, clashing):
    for df in (docs, hard, clashing):
        rows = mixing.taken(df).collect()
        assert len(rows) == df.count()
        check_mix(rows, [(r.source, r.text) for r in df.collect()])
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, mixing.taken(docs).collect()))
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_rows_follow_taken(docs, clashing):
    for df in (docs, clashing):
        taken = Counter()
        for r in mixing.taken(df).collect():
            taken[r.doc_id] += r.taken
        got = Counter()
        out = mixing.mixed(df, n_shards=8, block_docs=4)
        for r in out.select("doc_id", mixing.word_count(F.col("text")).alias("w")).collect():
            got[r.doc_id] += r.w
        assert +got == +taken
        assert out.columns[: len(df.columns)] == df.columns


def test_taken_counts_the_drawn_copies(spark, docs, hard):
    for df in (docs, hard):
        rows = mixing.taken(df, n_shards=8, block_docs=4).collect()
        assert all(r.taken == len(r.places) * r["size"] and list(r.places) == sorted(r.places) for r in rows)
        mixed = mixing.mixed(df, n_shards=8, block_docs=4, ordered=True).select("doc_id", "shard", "position", "copy").collect()
        assert Counter(map(tuple, mixed)) == Counter((r.doc_id, *p) for r in rows for p in r.places)
        assert [tuple(r)[1:] for r in mixed] == sorted(tuple(r)[1:] for r in mixed)
    assert {p.shard for r in mixing.taken(docs, n_shards=8, block_docs=4).collect() for p in r.places} == set(range(8))
    op7 = queries.QUERIES["op7_mixing"](spark, SF).select("doc_id", F.inline("places")).orderBy("shard", "position").collect()
    assert [r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect()] == [r.doc_id for r in op7]


def test_splitting_tree_deals_every_block_once():
    blocks = {"a": 1000, "b": 37, "c": 1}
    quotas = mixing.even_quotas(1038, 16)
    draws = list(mixing.split_blocks(blocks, quotas, 3))
    for name, n in blocks.items():
        own = sorted((a, b) for s, _, a, b in draws if s == name)
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    per = Counter()
    for _, shard, a, b in draws:
        per[shard] += b - a
    assert [per[k] for k in range(16)] == quotas.tolist() and max(quotas) - min(quotas) <= 1 and draws == list(mixing.split_blocks(blocks, quotas, 3))


def test_blocks_are_exact_and_drawn_whole(spark, docs):
    """Each source's copies make blocks of block_docs, the last one smaller; every block goes to one shard, as the tree drew it."""
    slim = mixing._slim(docs, 7)
    sources = mixing.source_table(slim)
    rows = mixing._drawn(slim, sources, 8, 4, 7).collect()
    blocks, shards = defaultdict(Counter), defaultdict(set)
    for r in rows:
        blocks[r.skey][r.block] += 1
        shards[r.skey, r.block].add(r["shard"])
    assert all(len(x) == 1 for x in shards.values())
    for own in blocks.values():
        assert sorted(own) == list(range(len(own))) and all(own[k] == 4 for k in range(len(own) - 1)) and 1 <= own[len(own) - 1] <= 4
    per = Counter(s for x in shards.values() for s in x)
    assert [per[k] for k in range(8)] == mixing.even_quotas(len(shards), 8).tolist()
    table = spark.createDataFrame([(k, len(v)) for k, v in blocks.items()], "skey string, n_blocks long")
    drawn = {(r.skey, b): r["shard"] for r in mixing.draws(table, 8, 7).collect() for b in range(r["first"], r.end)}
    assert drawn == {k: next(iter(v)) for k, v in shards.items()}


def test_many_sources(spark):
    """More sources than groups: targets equal the plain version, all blocks are dealt."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 9), f"host{rng.randint(0, 999)}" if i % 50 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute.mix_targets([(s, t) for _, t, s in rows])
    got = mixing.taken(df).collect()
    source = {i: s for i, _, s in rows}
    assert all(r.source_size == want[source[r.doc_id]][0] and abs(r.target - want[source[r.doc_id]][1]) < 1e-6 * max(1, r.target) for r in got)


def check_packing(rows, texts, tokenizer, length=packing.LENGTH):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for _, t in texts]
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(texts, ids, strict=True))
    by = defaultdict(list)
    for (i, _), x in zip(texts, ids, strict=True):
        by[i, len(x)].append(x)
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        own = by[r.doc_id, r.doc_tokens]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in own)
        covered[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({k: len(v) * k[1] for k, v in by.items()}) and sum(want.values()) == len(texts)
    for s, parts in sequences.items():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end == length or s == max(sequences)
    return sequences


def test_packing(spark, docs, hard, none, clashing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["a\x1cb ΣΑΣ İst don't we'll <|endoftext|> <| x", "École \x85 \x0b12ab3 ...!! ﻿ ½ ﬁ é.É!", "é ñ Å"]
    extra = spark.createDataFrame([(7000 + i, x, "en", "z", 0) for i, x in enumerate(odd)], docs.schema)
    for df in (docs.unionByName(extra), hard, clashing):
        check_packing(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()], t)
    assert packing.pack(none).count() == 0
    whole = packing.pack(extra, with_ids=True).orderBy("sequence_id", "offset").collect()
    assert sorted(i for r in whole for i in r.ids) == sorted(i for x in odd for i in [*t.encode(x, add_special_tokens=False).ids, 2])


def test_windows_are_deficit_round_robin():
    """What the queues spend equals token-by-token deficit round-robin, within a token of each."""
    tokens, shares, length = [5000, 2600, 900], [3.0, 2.0, 1.0], 100
    plan = packing.Schedule(tokens, shares, length)
    left, deficit, spent = tokens[:], [0.0] * 3, [0] * 3
    for w in range(85):
        room = float(length)
        while room > 1e-9:  # a queue that runs out leaves its share to the others
            open_ = [i for i in range(3) if left[i] - deficit[i] > 1e-9]
            unit = min([room / sum(shares[i] for i in open_)] + [(left[i] - deficit[i]) / shares[i] for i in open_])
            for i in open_:
                deficit[i] += shares[i] * unit
                room -= shares[i] * unit
        for i in range(3):
            k = min(left[i], int(deficit[i] + 0.5))
            left[i], deficit[i], spent[i] = left[i] - k, deficit[i] - k, spent[i] + k
        assert np.abs(plan.spent(np.array([w]))[0] - spent).max() <= 1
    assert plan.spent(np.array([84]))[0].tolist() == tokens


def variation(rows, share, length=packing.LENGTH):
    """Total variation of each full sequence's sources from share."""
    per = defaultdict(Counter)
    for r in rows:
        per[r.sequence_id][r.source] += r.length
    return {s: sum(abs(c[k] / length - share.get(k, 0)) for k in set(c) | set(share)) / 2 for s, c in per.items() if sum(c.values()) == length}


def test_every_sequence_has_its_target_proportions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    total = Counter()
    for r in rows:
        total[r.source] += r.length
    n = sum(total.values())
    off = variation(rows, {k: v / n for k, v in total.items()})
    assert len(off) == n // packing.LENGTH and sorted(off.values())[len(off) // 2] < 0.01 and max(off.values()) < 0.02
    # given shares, among them one of a source that isn't there: held until the first source runs out
    shares = {"src1": 4.0, "src2": 2.0, "nowhere": 1.0}
    rows = packing.pack(docs, shares=shares).collect()
    assert sum(r.length for r in rows) == n
    weight = {k: shares.get(k, 1.0) for k in total}
    share = {k: v / sum(weight.values()) for k, v in weight.items()}
    first = min(total[k] / share[k] for k in total) // packing.LENGTH
    off = variation(rows, share)
    assert first > 3 and all(off[s] < 0.02 for s in range(int(first)))


def test_queues_keep_a_given_order(spark):
    rows = [(i, f"word{i} " * 30, "ab"[i % 2], f"{(i * 37) % 101:03d}") for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, o string")
    got = packing.pack(df, length=64, order=F.col("o")).collect()
    place = {i: o for i, _, _, o in rows}
    for s in "ab":
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.sequence_id, r.offset))
        assert [place[r.doc_id] for r in own] == sorted(place[r.doc_id] for r in own)


def test_sources_beyond_the_queues_share_one(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "QUEUES", 3)
    df = spark.createDataFrame([(i, f"some text {i}", f"s{i % 7}" if i % 8 else None) for i in range(60)], "doc_id long, text string, source string")
    check_packing(packing.pack(df, length=16).collect(), [(r.doc_id, r.text) for r in df.collect()], Tokenizer.from_file(packing.default_tokenizer()), 16)


def plain_pipeline(spark, sf):
    """Documents before mixing, stage by stage on the driver."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grades = {r.doc_id: r.toxic for r in toxicity.toxic_grades(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if not grades[r.doc_id]}
    keep = set(brute.near_classes(texts).values())
    return {i: t for i, t in texts.items() if i in keep}


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        seen[name] = kept = spark.createDataFrame(kept.collect(), docs.schema)
    plain = plain_pipeline(spark, SF)
    clean = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert set(clean) == set(plain)
    for i, t in clean.items():
        assert brute.secrets(t)[:3] == (0, 0, 0) and (brute.secrets(plain[i])[:3] != (0, 0, 0) or "[SECRET]" in t or t == plain[i])
    mixed = seen["mixing"].collect()
    check_packing(corpus_pipeline.run(spark, SF).collect(), [(r.doc_id, r.text) for r in mixed], Tokenizer.from_file(packing.default_tokenizer()))


def test_pipeline_stages_on_hard_rows(spark, hard, none, clashing):
    for df in (hard, none, clashing):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), df.schema)
            assert docs.columns == df.columns
            assert df is none or name == "mixing" or {None, 4, 7, 8} <= {r.doc_id for r in docs.collect()}
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= docs.count()


def test_secrets_module_is_native():
    import inspect

    from lodestone.llm import linefreq, pseudonyms

    for module in (secrets, linefreq, pseudonyms):
        source = inspect.getsource(module)
        assert not any(x in source for x in ("pandas", "pyarrow", "mapInArrow", ".udf(", ".rdd"))
