"""An archive as a log of versions: entries are written once, a version adds and retires some, old versions stay readable.

Layout below a root: ``parts/<id>`` holds the facts of the entries that one
refresh wrote, clustered by entry; ``log/<version>`` the version's rows (entry,
hash, n, part; a null part retires the entry) and its token. A version is
written aside and published by one rename, which fails where the version exists
already: of two writers one has to begin again. A refresh that comes with the
token of a published version does nothing, so a stream's batch may come twice.

The rename is atomic on HDFS and local file systems; on object stores without it
a version needs a single writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.merge import entry_hashes
from lodestone.schema import REFERENCE
from lodestone.sources.store import materialise, write_clustered

LOG = "entry string, hash string, n bigint, part string"
DIGITS = 12


class Snapshots:
    """The versions of an archive of facts (REFERENCE columns), by entry (their file)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        log = self._path(f"{self.root}/log")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(log)) if self._fs.exists(log) else []

    def versions(self) -> list[int]:
        return [int(n.split("-")[0]) for n in self._names()]

    def tokens(self) -> set[str]:
        return {n.split("-", 1)[1] for n in self._names()}

    def log(self, version: int | None = None) -> DataFrame:
        """version, entry, hash, n, part of all versions up to one."""
        names = [n for n in self._names() if version is None or int(n.split("-")[0]) <= version]
        if not names:
            return self.spark.createDataFrame([], f"version bigint, {LOG}")
        rows = self.spark.read.schema(LOG).parquet(*(f"{self.root}/log/{n}" for n in names))
        return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "/log/([0-9]+)-", 1).cast("bigint").alias("version"), *[c.split()[0] for c in LOG.split(", ")])

    def entries(self, version: int | None = None) -> DataFrame:
        """entry, hash, n, part of the entries that a version (the last) holds."""
        last = F.max(F.struct("version", "hash", "n", "part")).alias("x")
        return self.log(version).groupBy("entry").agg(last).where("x.part IS NOT NULL").select("entry", "x.hash", "x.n", "x.part")

    def facts(self, version: int | None = None) -> DataFrame:
        """The facts of a version; only parts that still hold one of its entries are read."""
        live = materialise(self.entries(version).select("entry", "part"))
        parts = sorted(r["part"] for r in live.select("part").distinct().collect())  # one for each refresh
        if not parts:
            return self.spark.createDataFrame([], "file string, line bigint, start_col bigint, end_col bigint, symbol string, kind string")
        rows = self.spark.read.parquet(*(f"{self.root}/parts/{p}" for p in parts))
        rows = rows.withColumn("_part", F.regexp_extract(F.col("_metadata.file_path"), "/parts/([0-9a-f]+)/", 1))
        on = (rows["file"] == live["entry"]) & (F.col("_part") == live["part"])
        return rows.join(live, on, "left_semi").select(*REFERENCE)

    def refresh(self, facts: DataFrame, rebuilt: DataFrame, token: str | None = None) -> int | None:
        """Publish a version in which the rebuilt entries (entry) hold these facts; None where nothing changes.

        A rebuilt entry without facts is retired. Of the rebuilt ones only
        those whose content differs from what is there are written.
        Facts of other entries are an error, since they would be lost.
        """
        token = (token or uuid.uuid4().hex).replace("/", "_")
        if token in self.tokens():
            return None
        version = max(self.versions(), default=0) + 1
        asked = rebuilt.select("entry").distinct()
        facts = materialise(facts.select(*REFERENCE).distinct())
        stray = facts.select(F.col("file").alias("entry")).join(asked, "entry", "left_anti").limit(1).collect()
        if stray:
            raise ValueError(f"not among the rebuilt entries: {stray[0]['entry']}")
        new = entry_hashes(facts).withColumnRenamed("name", "entry")
        old = self.entries().select("entry", F.col("hash").alias("old_hash"))
        state = asked.join(new, "entry", "left").join(old, "entry", "left")
        part = uuid.uuid4().hex
        changed = materialise(state.where("NOT hash <=> old_hash").select("entry", "hash", F.when(F.col("hash").isNotNull(), F.col("n")).alias("n"), F.when(F.col("hash").isNotNull(), F.lit(part)).alias("part")))
        if not changed.limit(1).count():
            return None
        written = facts.join(changed.where("part IS NOT NULL").select(F.col("entry").alias("file")), "file", "left_semi").select(*REFERENCE)
        write_clustered(written, f"{self.root}/parts/{part}", list(REFERENCE))
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        changed.coalesce(1).write.parquet(aside)  # a row per changed entry
        self._publish(aside, version, token)
        return version

    def _publish(self, aside: str, version: int, token: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        if version in self.versions():
            raise RuntimeError(f"version {version} was published meanwhile")
        if not self._fs.rename(self._path(aside), self._path(f"{self.root}/log/{version:0{DIGITS}d}-{token}")):
            raise RuntimeError(f"version {version} was published meanwhile")
