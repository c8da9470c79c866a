"""Lookups in written indexes, versions of an archive, maintained definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import tables, xref
from lodestone.operators.maintained import Definitions
from lodestone.operators.snapshots import Snapshots
from lodestone.schema import FACTS, REFERENCE
from lodestone.sources.keyed import Keyed, files_of, write_keyed
from lodestone.streaming.sessions import definitions_stream, snapshot_stream

KEYS = "a string, b bigint, c bigint"


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.fixture(scope="module")
def keyed(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = sorted({(rng.choice([None, "a", "b", "é", "zz"]), rng.choice([None, *range(12)]), i) for i in range(700)}, key=key)
    rows += [("hot", 5, 1000 + i) for i in range(300)]
    path = str(tmp_path_factory.mktemp("keyed") / "x")
    write_keyed(spark.createDataFrame(rows, KEYS).repartition(3), path, ["a", "b", "c"], 10)
    return Keyed(spark, path), rows, path


def test_files_are_listed(spark, keyed):
    k, rows, path = keyed
    listed = files_of(spark, path).collect()
    assert len(listed) > 5 and sum(r["rows"] for r in listed) == len(rows) == spark.read.parquet(path).count()
    assert k.first == sorted(k.first) and all(a <= b for a, b in zip(k.first, k.last, strict=True))


@pytest.mark.parametrize("wanted", [[("a", 3)], [("hot", 5)], [(None, None), ("é", 0), ("no", 1)], [("a", 3), ("a", 3), ("zz", 11)]])
def test_lookup_reads_few_files(spark, keyed, wanted):
    k, rows, path = keyed
    got = k.lookup(spark.createDataFrame(wanted, "a string, b bigint"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in rows if r[:2] in wanted), key=key)
    spread = {i for i, (lo, hi) in enumerate(zip(k.first, k.last, strict=True)) for w in wanted if lo[:2] <= key(w) <= hi[:2]}
    assert len([f for f in got.inputFiles() if path in f]) == len(spread) < len(k.files)


def test_lookup_by_other_prefixes(spark, keyed):
    k, rows, _ = keyed
    own = k.lookup(spark.createDataFrame([("b",)], "a string"))
    assert sorted(map(tuple, own.collect()), key=key) == sorted((r for r in rows if r[0] == "b"), key=key)
    full = rows[5]
    assert [tuple(r) for r in k.lookup(spark.createDataFrame([full], KEYS)).collect()] == [full]
    ranged = k.lookup(spark.createDataFrame([("a", 2, 4), ("zz", 0, 99), ("b", 9, 1)], "a string, b bigint, upto bigint"), upto="upto")
    assert sorted(map(tuple, ranged.collect()), key=key) == sorted((r for r in rows if r[1] is not None and (r[0] == "a" and 2 <= r[1] <= 4 or r[0] == "zz")), key=key)
    with pytest.raises(ValueError, match="not the first"):
        k.lookup(spark.createDataFrame([(1,)], "b bigint"))
    assert k.lookup(spark.createDataFrame([], "a string")).count() == 0


def test_lower_bounds(spark, keyed):
    k, rows, _ = keyed
    for m, wanted in ((1, [(None,), ("",), ("b",), ("c",), ("hot",), ("zzz",)]), (2, [("a", 3), ("a", 100), (None, None), ("é", 5), ("zz", 12), ("hot", 6)]), (3, [rows[0], rows[-1], ("hot", 5, 1299), ("hot", 5, 1300)])):
        got = k.lower_bounds(spark.createDataFrame(wanted, ", ".join(KEYS.split(", ")[:m]))).collect()
        want = {w: next((r for r in sorted(rows, key=key) if key(r)[:m] >= key(w)), None) for w in wanted}
        assert {tuple(r)[:m]: tuple(r["found"]) if r["found"] else None for r in got} == want


def test_keyed_without_rows(spark, tmp_path):
    write_keyed(spark.createDataFrame([], KEYS), str(tmp_path / "none"), ["a", "b", "c"])
    k = Keyed(spark, str(tmp_path / "none"))
    assert k.files == []


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def some(n, seed=0):
    rng = random.Random(seed)
    return [(f"@/f{rng.randrange(9)}", rng.randrange(5), rng.randrange(4), 4 + rng.randrange(3), f"s{rng.randrange(25)}", rng.choice(["Definition", "Declaration", "Called"]), rng.choice(["Class", "Parameter", None])) for _ in range(n)]


def test_written_references(spark, tmp_path):
    df = facts(spark, some(300))
    tables.build_index(df).write(str(tmp_path / "i"))
    wanted = spark.createDataFrame([("s3",), ("s7",), ("none",)], "symbol string")
    got = tables.written_references(spark, str(tmp_path / "i"), wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.where("symbol IN ('s3', 's7')").select(*REFERENCE).distinct().collect()))


# --- versions -------------------------------------------------------------


def names(df):
    return df.select(F.col("file").alias("entry")).distinct()


def rows_of(df):
    return sorted(map(tuple, df.select(*REFERENCE).collect()))


def test_versions(spark, tmp_path):
    store, df = Snapshots(spark, str(tmp_path / "s")), facts(spark, some(200))
    assert store.versions() == [] and store.facts().count() == 0 and store.entries().count() == 0
    assert store.refresh(df, names(df), "one") == 1
    first = rows_of(store.facts())
    assert first == rows_of(df.distinct().select(*REFERENCE).distinct())
    changed = df.where("file IN ('@/f1', '@/f2') AND line > 1")
    wanted = spark.createDataFrame([("@/f1",), ("@/f2",), ("@/f3",)], "entry string")
    same_f3 = df.where("file = '@/f3'")
    assert store.refresh(changed.unionByName(same_f3), wanted, "two") == 2
    log = {r["entry"]: r["n"] for r in store.log().where("version = 2").collect()}
    assert set(log) == {"@/f1", "@/f2"}  # of three rebuilt entries two have changed, so two are written
    part = store.log().where("version = 2").select("part").distinct().collect()[0][0]
    assert {r["file"] for r in spark.read.parquet(f"{tmp_path}/s/parts/{part}").select("file").distinct().collect()} == {"@/f1", "@/f2"}
    assert rows_of(store.facts()) == rows_of(df.where("file NOT IN ('@/f1', '@/f2')").unionByName(changed).select(*REFERENCE).distinct())
    assert rows_of(store.facts(1)) == first
    assert store.refresh(df.limit(0), wanted, "two") is None and store.versions() == [1, 2]  # the same batch again
    assert store.refresh(same_f3, names(same_f3)) is None  # nothing changes
    assert store.refresh(df.limit(0), spark.createDataFrame([("@/f3",), ("@/none",)], "entry string"), "three") == 3
    assert [tuple(r) for r in store.log().where("version = 3").collect()] == [(3, "@/f3", None, None, None)]
    assert "@/f3" not in {r["entry"] for r in store.entries().collect()} and "@/f3" in {r["entry"] for r in store.entries(2).collect()}
    assert store.refresh(same_f3, names(same_f3), "back") == 4 and store.entries().where("entry = '@/f3'").count() == 1


def test_only_rebuilt_entries_may_come(spark, tmp_path):
    store, df = Snapshots(spark, str(tmp_path / "s")), facts(spark, some(20))
    with pytest.raises(ValueError, match="not among"):
        store.refresh(df, names(df).where("entry <> '@/f1'"))
    with pytest.raises(ValueError, match="not among"):
        store.refresh(df.withColumn("file", F.lit(None).cast("string")), names(df))
    assert store.versions() == []


def test_one_of_two_writers_wins(spark, tmp_path):
    store, df = Snapshots(spark, str(tmp_path / "s")), facts(spark, some(20))
    store.refresh(df, names(df), "a")
    with pytest.raises(RuntimeError, match="meanwhile"):
        store._publish(f"{tmp_path}/nowhere", 1, "b")


def test_versions_of_a_stream(spark, tmp_path):
    df = facts(spark, some(150))
    store = Snapshots(spark, str(tmp_path / "s"))
    for i, batch in enumerate((["@/f1", "@/f2"], ["@/f2", "@/f4"], ["@/f9"])):
        spark.createDataFrame([(x,) for x in batch], "entry string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    changed = spark.readStream.schema("entry string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rebuild = lambda entries: df.join(entries.withColumnRenamed("entry", "file"), "file", "left_semi")
    snapshot_stream(changed, store, rebuild, f"{tmp_path}/check").awaitTermination()
    assert rows_of(store.facts()) == rows_of(df.where("file IN ('@/f1', '@/f2', '@/f4')").select(*REFERENCE).distinct())
    before = store.versions()
    assert 1 <= len(before) <= 3
    snapshot_stream(changed, store, rebuild, f"{tmp_path}/check-lost").awaitTermination()  # every batch comes again
    assert store.versions() == before


# --- maintained definitions -----------------------------------------------


def signed(spark, rows):
    return spark.createDataFrame(rows, f"{FACTS}, sign int")


def same_as_recomputed(spark, view, live):
    df = facts(spark, live) if live else facts(spark, [])
    want = sorted(map(str, xref.single_definition(df).where("n_def > 0 OR n_decl > 0").collect()))
    assert sorted(map(str, view.single().collect())) == want
    assert sorted(map(str, view.global_definitions().collect())) == sorted(map(str, xref.global_definitions(df).collect()))


def test_batches_equal_a_new_count(spark, tmp_path):
    """Facts come several times and go again; the least place of a symbol goes."""
    view, rng, live = Definitions(spark, str(tmp_path / "d")), random.Random(3), []
    same_as_recomputed(spark, view, [])
    for batch in range(1, 5):
        come = some(60, batch)
        go = rng.sample(live, min(len(live), 40))
        if batch == 3:  # the least definition of every symbol goes
            least = {}
            for r in sorted(x for x in live if x[5] == "Definition" and x[6] is not None):
                least.setdefault(r[4], r)
            go = [x for x in live if x[:6] in {r[:6] for r in least.values()}]
        for x in go:
            live.remove(x)
        live += come
        rows = [(*r, 1) for r in come] + [(*r, -1) for r in go]
        assert view.apply(signed(spark, rows), batch)
        assert not view.apply(signed(spark, rows), batch)  # the same batch again
        same_as_recomputed(spark, view, live)
    assert view.batches() == [1, 2, 3, 4]


def test_more_than_there_is_cannot_go(spark, tmp_path):
    view, row = Definitions(spark, str(tmp_path / "d")), some(1)[0]
    view.apply(signed(spark, [(*row, 1), (*row, 1), (None, 1, 1, 1, "s", "Definition", None, 1), (*row, None)]), 1)
    view.apply(signed(spark, [(*row, -1)]), 2)
    same_as_recomputed(spark, view, [row])
    with pytest.raises(ValueError, match="taken away"):
        view.apply(signed(spark, [(*row, -2)]), 3)
    assert view.batches() == [1, 2]
    assert view.apply(signed(spark, []), 4)
    same_as_recomputed(spark, view, [row])


def test_definitions_of_a_stream(spark, tmp_path):
    rows = some(80, 9)
    for i in range(2):
        signed(spark, [(*r, 1) for r in rows[i::2]]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    changes = spark.readStream.schema(f"{FACTS}, sign int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    view = Definitions(spark, str(tmp_path / "d"))
    definitions_stream(changes, view, f"{tmp_path}/check").awaitTermination()
    same_as_recomputed(spark, view, rows)
    definitions_stream(changes, view, f"{tmp_path}/check-lost").awaitTermination()
    same_as_recomputed(spark, view, rows)
