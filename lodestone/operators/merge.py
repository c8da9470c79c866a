"""Merging indexes, archives of hashed entries, and incremental reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.dictionary import ranked
from lodestone.operators.tables import CodeIndex, build_index
from lodestone.schema import REFERENCE
from lodestone.sources.store import layout, materialise, write_clustered


def merge_facts(*parts: DataFrame) -> DataFrame:
    """Union of fact sets without repeats; the parts must have the same columns."""
    first, *rest = parts
    for p in rest:
        if set(p.columns) != set(first.columns):
            raise ValueError(f"columns differ: {first.columns} and {p.columns}")
        first = first.unionByName(p)
    return first.distinct()


def merge_indexes(*parts: DataFrame) -> CodeIndex:
    """One index of all parts: facts are united as values and encoded once, so no id is remapped."""
    return build_index(merge_facts(*parts))


#: Facts of an entry that are hashed as one text.
HASHED = 4096


def entry_hashes(facts: DataFrame, entry: str = "file") -> DataFrame:
    """name, hash, n: one row per entry.

    The hash is the SHA-256 of the hashes, in order, of the blocks of HASHED
    sorted facts (an entry's own name in them), so no entry is gathered in one
    row: its facts are ranked over all partitions.
    """
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in REFERENCE])
    rows = ranked(facts.select(F.col(entry).alias("name"), line.alias("row")).distinct(), ["name", "row"], "at")
    first = rows.groupBy("name").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = rows.join(first, "name").groupBy("name", "n", F.floor((F.col("at") - F.col("first")) / HASHED).alias("block"))
    blocks = blocks.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("h"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"])
    return blocks.groupBy("name", "n").agg(F.sha2(F.array_join(hashes, "\n"), 256).alias("hash")).select("name", "hash", "n")


def first_of_hash(entries: DataFrame, order: list[str], key: str = "hash") -> DataFrame:
    """Of the entries of one hash the first in order.

    The least struct per hash, which each map task reduces first; a window over
    a hash that most entries share would gather them all.
    """
    rest = [c for c in entries.columns if c not in {key, *order}]
    best = F.min(F.struct(*order, *rest)).alias("b")
    return entries.groupBy(key).agg(best).select(key, "b.*").select(*entries.columns)


def united(*parts: DataFrame, entry: str = "file") -> DataFrame:
    """The facts of several parts of an archive; an entry may come from one part only."""
    names = None
    for k, p in enumerate(parts):
        own = p.select(F.col(entry).alias("name"), F.lit(k).alias("part")).distinct()
        names = own if names is None else names.unionByName(own)
    twice = names.groupBy("name").count().where("count > 1").orderBy("name").limit(1).collect()
    if twice:
        raise ValueError(f"an archive holds an entry once: {twice[0]['name']}")
    return merge_facts(*parts)


def write_archive(facts: DataFrame, path: str, entry: str = "file", compressed: bool = True) -> None:
    """Facts clustered by entry, so that statistics lead to one entry's row groups, and a manifest of names, hashes and lengths."""
    write_clustered(facts.withColumn("entry_name", F.col(entry)), f"{path}/entries", ["entry_name", *REFERENCE], compression="snappy" if compressed else "uncompressed")
    entry_hashes(facts, entry).write.parquet(f"{path}/manifest")


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    if layout(spark, path) != "archive":
        raise ValueError(f"not an archive: {path}")
    return spark.read.parquet(f"{path}/manifest")


def open_entry(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Facts of one entry; row groups of other entries are not read."""
    return spark.read.parquet(f"{path}/entries").where(F.col("entry_name") == name).drop("entry_name")


def merge_archives(archives: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the entries that no earlier archive has. archives: archive, entry, hash; facts: archive, entry and a fact."""
    kept = first_of_hash(archives.select("archive", "entry", "hash"), ["archive", "entry"]).select("archive", "entry")
    return facts.join(kept, ["archive", "entry"], "left_semi").drop("archive", "entry").distinct()


def reusable(entries: DataFrame, mtimes: DataFrame) -> DataFrame:
    """index_file, reusable: all inputs exist and none is newer than the index.

    entries: index_file, index_mtime (null: no index), name; mtimes: name, mtime.
    Names that begin with < or NUL are no files. Equal times are fresh.
    """
    named = entries.where("name IS NOT NULL AND NOT startswith(name, '<') AND NOT startswith(name, chr(0))")
    judged = named.join(mtimes, "name", "left").select("index_file", F.coalesce(F.col("mtime") <= F.col("index_mtime"), F.lit(False)).alias("fresh"))
    per = judged.groupBy("index_file").agg(F.bool_and("fresh").alias("fresh"))
    every = entries.groupBy("index_file").agg(F.max("index_mtime").alias("index_mtime"))
    return every.join(per, "index_file", "left").select("index_file", (F.col("index_mtime").isNotNull() & F.coalesce("fresh", F.lit(True))).alias("reusable"))


def refresh(spark: SparkSession, old: str, out: str, index_mtimes: DataFrame, mtimes: DataFrame, rebuild: Callable[[DataFrame], DataFrame]) -> None:
    """Write an archive at out from the one at old: entries that are fresh are taken over, all others (name) are rebuilt.

    index_mtimes: index_file, index_mtime, name, as in reusable(); an entry's
    index file bears its name. Entries of one content are kept once.
    """
    state = materialise(reusable(index_mtimes, mtimes))
    kept = spark.read.parquet(f"{old}/entries").join(state.where("reusable").select(F.col("index_file").alias("entry_name")), "entry_name", "left_semi").drop("entry_name")
    fresh = rebuild(state.where("NOT reusable").select(F.col("index_file").alias("name")))
    facts = materialise(united(kept, fresh.select(*kept.columns)))
    first = first_of_hash(entry_hashes(facts).select("hash", "name"), ["name"])
    write_archive(facts.join(first.select(F.col("name").alias("file")), "file", "left_semi").select(*facts.columns), out)


def entry_position(manifest: DataFrame, name: str) -> DataFrame:
    """position of an entry in the archive's order of names, -1 where it has none."""
    hit = manifest.agg(F.count_if(F.col("name") < name).alias("before"), F.count_if(F.col("name") == name).alias("n"))
    return hit.select(F.when(F.col("n") > 0, F.col("before")).otherwise(-1).cast("bigint").alias("position"))


def archive_stats(facts: DataFrame, entry: str = "file") -> DataFrame:
    """name, hash, n, symbols of each entry: the archive's dump by entry."""
    counts = facts.groupBy(F.col(entry).alias("name")).agg(F.count_distinct("symbol").alias("symbols"))
    return entry_hashes(facts, entry).join(counts, "name")


def catalog_stats(index: CodeIndex) -> DataFrame:
    """part, name, n, bytes of every dictionary and table (bytes: of dictionaries)."""
    out = None
    for kind, parts in (("dictionary", index.dictionaries), ("table", index.tables)):
        for name, df in sorted(parts.items()):
            size = F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)) if kind == "dictionary" else F.lit(None)
            row = df.agg(F.count("*").alias("n"), size.cast("bigint").alias("bytes")).select(F.lit(kind).alias("part"), F.lit(name).alias("name"), "n", "bytes")
            out = row if out is None else out.unionByName(row)
    return out


def dump(index: CodeIndex, name: str) -> DataFrame:
    """A table's rows as JSON with values for ids."""
    return index.decoded(name).select(F.to_json(F.struct("*")).alias("json"))


__all__ = ["archive_stats", "catalog_stats", "dump", "entry_hashes", "entry_position", "first_of_hash", "merge_archives", "merge_facts", "merge_indexes", "open_archive", "open_entry", "refresh", "reusable", "united", "write_archive"]
