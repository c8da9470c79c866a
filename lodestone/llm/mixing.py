"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: weights share out the words of all documents among the sources; a
source stops at ``max_repeat`` times its own size and the excess is shared
again by weight. Copies: every document of a source is taken floor(f) or
ceil(f) times, f = target / size; how many documents of each size get the
extra copy is settled from the largest size to the smallest, each size making
up for the rounding of those before it, so a source misses its target by about
half of a small document. Which ones get it is settled by a keyed hash.

Output shards: the copies of a source are permuted by a keyed hash and cut
into disjoint blocks of block_docs each (the last may be smaller). The tree
starts with all block counts and all shards, and halves the shards again and
again; how many blocks of each source go left is a multivariate-hypergeometric
draw, so every shard gets an exact count of blocks and every source's blocks
are shared out as in a random deal. Each shard draws its quota of each source's
permuted blocks, and is shuffled by itself.

The tree is drawn in two steps, which give the same distribution: first for
GROUPS groups of sources, on the driver, then, a task per group, for the
sources of each group within the group's quotas. So what comes to the driver
is bounded, whatever the number of sources. Targets come from sums over the
table of sources, a few passes; a source's documents of each size are one row
of its histogram; document rows are ranked in buckets.

Edge cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; rows that share an id or have none are
documents of their own, told apart by their texts' hash, and rows that are
equal in all get copies alike but for the last extra copy; an empty table gives
an empty result; extra columns are kept by ``mixed`` (its own are shard,
position and copy, each left out where the documents have one of that name) and
ignored by ``taken``, which counts the copies that the shards drew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import bucket_bits, running_total, spread_join, word_count, written
from lodestone.operators.dictionary import ranked

BUCKETS = 256
GROUPS = 256
#: Blocks that a draw may hold; numpy's limit is 10^9.
DRAWN = 500_000_000
NULL = "\x00"
PLAN = "skey string, size long, n long, base long, extra long"


def source_key(source: Column) -> Column:
    """A source as a join key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(NULL))


def keyed(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def source_table(slim: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0) -> DataFrame:
    """skey, source_size, target: one row per source; weights repeat along the code-point order of the sources, null last.

    The words that a unit of weight gets rise as sources stop at their limit;
    each pass is one row of sums, and ends when no more sources stop.
    """
    per = slim.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("skey") == NULL)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("at", F.lit(len(weights))).cast("int"))
    found = written(ranked(per, ["last", "skey"], "at").select("skey", "source_size", weight.alias("weight")))
    some = found.where("source_size > 0")

    def sums(unit: float) -> tuple[int, int, float]:
        full = F.col("weight") * F.lit(unit) > max_repeat * F.col("source_size")
        r = some.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("s"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        return r["n"], r["s"] or 0, r["w"] or 0.0

    total, stopped, unit = some.agg(F.sum("source_size").alias("n")).first()["n"] or 0, -1, 0.0
    n, size, open_ = sums(unit)
    while n != stopped and open_:
        stopped, unit = n, (total - max_repeat * size) / open_
        n, size, open_ = sums(unit)
    own = F.least(F.col("weight") * F.lit(unit), max_repeat * F.col("source_size")).cast("double")
    return found.select("skey", "source_size", own.alias("target"))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of one source, largest size first; the error carries on."""
    pdf = pdf.sort_values("size", ascending=False)
    total, target = float(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    f = target / total if total else 0.0
    base = int(np.floor(f + 1e-12))
    share = f - base
    rest, owed, extra = float((pdf["size"] * pdf["n"]).sum()), 0.0, []
    for size, n in zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True):
        if not size:
            extra.append(0)
            continue
        rest -= size * n  # words of smaller documents, which can make up for what is left over here
        owed += share * size * n
        k = max(0, int(np.floor(owed / size + 1e-9)))
        over = owed - k * size
        if over > (1 - share) * rest and (size - over <= share * rest or over > size / 2):
            k += 1
        k = min(n, k)
        owed -= k * size
        extra.append(k)
    return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "n": pdf["n"], "base": np.where(pdf["size"] > 0, base, 0), "extra": extra})


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    """row, doc_id, skey, size, h, hb of every row of docs, written; texts are read once."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), keyed(seed, F.col("doc_id"), F.xxhash64("text")).alias("h"))
    return written(own.withColumn("hb", F.pmod("h", F.lit(BUCKETS)).cast("int")))


def _plan(buckets: DataFrame, sources: DataFrame) -> DataFrame:
    """skey, size, n, base, extra: n documents of a size get base copies each and extra of them one more."""
    sizes = buckets.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(sources, "skey")
    return sizes.groupBy("skey").applyInPandas(_fold, PLAN)


def _copies(slim: DataFrame, buckets: DataFrame, plan: DataFrame) -> DataFrame:
    """row, skey, h, rank, copy: one row per copy. The extra copies of a size go to the first buckets of the hash, within the last bucket to its first rows."""
    before = F.sum("n").over(W.partitionBy("skey", "size").orderBy("hb").rowsBetween(W.unboundedPreceding, -1))
    share = buckets.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, ["skey", "size"]).select("skey", "size", "hb", "base", (F.col("extra") - F.col("before")).alias("quota"))
    ranks = slim.select("row", "skey", "size", "h", "hb", F.row_number().over(W.partitionBy("skey", "size", "hb").orderBy("h", "row")).cast("long").alias("rank"))
    copies = F.col("base") + (F.col("rank") <= F.col("quota")).cast("long")
    own = ranks.join(share, ["skey", "size", "hb"]).withColumn("copies", copies).where("copies > 0")
    return own.select("row", "skey", "h", "rank", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def _halves(counts: np.ndarray, quotas: np.ndarray, first: int, seed: int, path: str) -> Iterable[tuple[int, np.ndarray]]:
    """(shard, blocks of each source) by the splitting tree; quotas: blocks that each shard from first on gets."""
    if len(quotas) == 1:
        yield first, counts
        return
    half = len(quotas) // 2
    rng = np.random.default_rng([seed, zlib.crc32(path.encode())])
    n = int(quotas[:half].sum())
    left = rng.multivariate_hypergeometric(counts, n, method="marginals") if n else np.zeros_like(counts)
    yield from _halves(left, quotas[:half], first, seed, path + "l")
    yield from _halves(counts - left, quotas[half:], first + half, seed, path + "r")


def even_quotas(total: int, n_shards: int) -> np.ndarray:
    """Blocks of each shard, as equal as can be: halves of halves."""
    if n_shards == 1:
        return np.array([total], np.int64)
    half = n_shards // 2
    left = total * half // n_shards
    return np.concatenate([even_quotas(left, half), even_quotas(total - left, n_shards - half)])


def _split(blocks: dict[str, int], quotas: np.ndarray, seed: int, path: str) -> Iterable[tuple[str, int, int, int]]:
    names = sorted(blocks)
    given = np.zeros(len(names), np.int64)
    for shard, k in _halves(np.array([blocks[x] for x in names], np.int64), quotas, 0, seed, path):
        for i in np.flatnonzero(k).tolist():
            yield names[i], shard, int(given[i]), int(given[i] + k[i])
        given += k


def split_blocks(blocks: dict[str, int], quotas: np.ndarray, seed: int, path: str = "") -> Iterable[tuple[str, int, int, int]]:
    """(source, shard, first, end) of the shards' draws of each source's permuted blocks; the shards' quotas add up to all blocks.

    Draws take under DRAWN blocks. Of more, super-blocks of as many neighbouring
    blocks as needed are dealt first, then the blocks left over, so a shard may
    have two ranges of a source; quotas hold exactly.
    """
    unit = -(-sum(blocks.values()) // DRAWN)
    if unit <= 1:
        yield from _split(blocks, quotas, seed, path)
        return
    whole, share = {k: n // unit for k, n in blocks.items()}, quotas // unit
    over = sum(whole.values()) - int(share.sum())
    for k in sorted(whole, key=lambda k: (-whole[k], k)):  # more super-blocks than the shards have room for: some stay blocks
        less = min(whole[k], max(over, 0))
        whole[k], over = whole[k] - less, over - less
    while over < 0:
        most = np.argsort(-share, kind="stable")[: -over]
        most = most[share[most] > 0]
        share[most] -= 1
        over += len(most)
    if not any(whole.values()):
        raise ValueError("more sources than blocks can be drawn for")
    for k, shard, first, end in _split(whole, share, seed, path + "u"):
        yield k, shard, first * unit, end * unit
    rest = {k: n - whole[k] * unit for k, n in blocks.items()}
    for k, shard, first, end in split_blocks(rest, quotas - share * unit, seed, path + "r"):
        yield k, shard, whole[k] * unit + first, whole[k] * unit + end


DRAWS = "skey string, shard long, first long, end long"


def draws(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """skey, shard, first, end for blocks (skey, n_blocks): groups of sources are split on the driver, sources within their group's quotas in a task per group."""
    grouped = blocks.where("n_blocks > 0").withColumn("g", F.pmod(F.xxhash64("skey"), F.lit(GROUPS)).cast("int"))
    totals = {f"{r['g']:05d}": int(r["n"]) for r in grouped.groupBy("g").agg(F.sum("n_blocks").alias("n")).collect()}  # GROUPS rows at most
    parts = list(split_blocks(totals, even_quotas(sum(totals.values()), n_shards), seed)) if totals else []
    quotas = blocks.sparkSession.createDataFrame([(int(g), shard, end - first) for g, shard, first, end in parts], "g int, shard int, quota long")

    def draw(key: tuple, own: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        q = np.zeros(n_shards, np.int64)
        np.add.at(q, quota["shard"].to_numpy(), quota["quota"].to_numpy())
        found = list(split_blocks(dict(zip(own["skey"], own["n_blocks"].astype(int), strict=True)), q, seed, f"{key[0]}:")) if len(own) else []
        return pd.DataFrame(found, columns=[c.split()[0] for c in DRAWS.split(", ")])

    return grouped.groupBy("g").cogroup(quotas.groupBy("g")).applyInPandas(draw, DRAWS)


def _drawn(slim: DataFrame, sources: DataFrame, n_shards: int, block_docs: int, seed: int) -> DataFrame:
    """row, shard, position, copy of every copy in the mix; block too."""
    buckets = slim.groupBy("skey", "size", "hb").agg(F.count("*").alias("n"))
    plan = written(_plan(buckets, sources))
    per = plan.groupBy("skey").agg(F.sum(F.col("n") * F.col("base") + F.col("extra")).alias("n"))
    total = per.agg(F.sum("n").alias("n")).first()["n"] or 0
    ends = draws(per.select("skey", F.ceil(F.col("n") / block_docs).cast("long").alias("n_blocks")), n_shards, seed).groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    copies = _copies(slim, buckets, plan).withColumn("k", F.shiftrightunsigned(keyed(seed + 1, F.col("h"), F.col("rank"), F.col("copy")), 1))
    copies = running_total(copies, ["skey"], [F.col("k"), F.col("row"), F.col("copy")], F.shiftrightunsigned("k", 63 - bucket_bits(total)), F.lit(1).cast("long"), "at")
    placed = spread_join(copies.withColumn("block", F.floor((F.col("at") - 1) / block_docs).cast("long")), ends, ["skey"], F.col("row"))
    shard = F.filter("ends", lambda e: e["end"] > F.col("block"))[0]["shard"]
    return placed.select("row", shard.alias("shard"), keyed(seed + 2, F.col("h"), F.col("rank"), F.col("copy")).alias("position"), "copy", "skey", "block")


def taken(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0, n_shards: int = 64, block_docs: int = 32, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, places: one row per row of docs.

    places: array<struct<shard, position, copy>>, one for each copy in the mix, in the mix's order; taken counts their words.
    """
    slim = _slim(docs, seed)
    sources = written(source_table(slim, weights, max_repeat))
    places = _drawn(slim, sources, n_shards, block_docs, seed).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("shard", "position", "copy"))).alias("places"))
    rows = spread_join(slim.select("row", "doc_id", "skey", "size"), sources, ["skey"], F.col("row")).join(places, "row", "left")
    rows = rows.withColumn("places", F.coalesce("places", F.array().cast("array<struct<shard:long,position:long,copy:long>>")))
    return rows.select("doc_id", "size", "source_size", "target", (F.size("places") * F.col("size")).cast("long").alias("taken"), "places")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0, n_shards: int = 64, block_docs: int = 32, seed: int = 7, ordered: bool = False) -> DataFrame:
    """The mix: docs' columns with copy, shard and position long; a document stands there once per copy.

    The order of the mix is (shard, position); ordered deals the rows to
    partitions in it and sorts each. docs is read twice and must give its rows
    in the same order each time, as files do.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    slim = _slim(docs, seed)
    sources = written(source_table(slim, weights, max_repeat))
    places = written(_drawn(slim, sources, n_shards, block_docs, seed).select("row", "shard", "position", "copy"))
    rows = docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()).join(places, "row").drop("row")
    if ordered:
        words = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
        parts = max(1, -(-words // (n_shards * 8_000_000)))  # of a shard
        part = F.least(F.floor((F.col("position") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1))
        rows = rows.repartitionById(n_shards * parts, (F.col("shard") * parts + part).cast("int")).sortWithinPartitions("shard", "position", "copy")
    own_names = [c for c in ("copy", "shard", "position") if c not in docs.columns]
    return rows.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], *own_names)
