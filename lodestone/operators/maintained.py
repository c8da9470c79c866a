"""Definitions per symbol, kept up to date by signed changes of facts.

Facts have multiplicities (several units can state one); a change that takes one
from none to some, or back, moves the symbol's number of definitions and
declarations by one and may lower its least places. Only a symbol that loses the
very place that is its least needs its facts again. What a batch reads and
writes is what it touches: logs of changes and of views, both in buckets
of symbols, from which untouched buckets are left out.

A batch is published by a marker after its rows are written and counts from then
on; one that comes again (same number) is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.schema import DECLARATION, DEFINITION, LOCAL_TYPES, PATH_TYPE, REFERENCE
from lodestone.sources.store import materialise

PLACE = "struct<file:string,line:bigint,start_col:bigint,end_col:bigint,kind:string>"
VIEW = f"symbol string, n_def bigint, n_decl bigint, d {PLACE}, c {PLACE}"
FACT = "file string, line bigint, start_col bigint, end_col bigint, symbol string, kind string, change bigint"
TYPES = "symbol string, symbol_type string, change bigint"
BUCKETS = 64


class Definitions:
    """The view below a root folder, in buckets of symbols; their number stays as it was at the first batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _published(self) -> dict[int, str]:
        done = self._path(f"{self.root}/done")
        names = [s.getPath().getName() for s in self._fs.listStatus(done)] if self._fs.exists(done) else []
        return {int(n.split("-")[0]): n.split("-")[1] for n in names}

    def batches(self) -> list[int]:
        return sorted(self._published())

    def _log(self, what: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a log's published batches, with batch and bucket, of some buckets only."""
        folders = [f"{self.root}/{what}/batch={b}/try={t}" for b, t in self._published().items()]
        full = f"{schema}, batch bigint, try string, bucket int"
        if not folders:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/{what}").parquet(*folders)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Take in a batch of signed facts (REFERENCE columns, symbol_type, sign); False where the number was taken in before.

        More facts taken away than there are is an error. Rows with a null in a
        REFERENCE column or without a sign are no facts and are left out.
        """
        if batch in self._published():
            return False
        changes = changes.dropna(subset=[*REFERENCE, "sign"])
        own = uuid.uuid4().hex  # a try that broke off leaves rows that no marker names
        facts = materialise(changes.groupBy(*REFERENCE).agg(F.sum("sign").cast("bigint").alias("change")).where("change <> 0").withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(self.buckets))))
        types = changes.where("symbol_type IS NOT NULL").groupBy("symbol", "symbol_type").agg(F.sum("sign").cast("bigint").alias("change")).where("change <> 0").withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(self.buckets)))
        touched = [r["bucket"] for r in facts.select("bucket").distinct().collect()]  # as many as buckets at most
        before = self._log("facts", FACT, touched).join(facts.select(*REFERENCE), list(REFERENCE), "left_semi").groupBy(*REFERENCE).agg(F.sum("change").alias("had"))
        moved = materialise(facts.join(before, list(REFERENCE), "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn("has", F.col("had") + F.col("change")))
        gone = moved.where("has < 0").limit(1).collect()
        if gone:
            raise ValueError(f"more of a fact is taken away than there is: {gone[0].asDict()}")
        place = F.struct("file", "line", "start_col", "end_col", "kind")
        turns = moved.where("(had = 0) <> (has = 0)").select("symbol", "bucket", "kind", place.alias("p"), F.when(F.col("had") == 0, 1).otherwise(-1).alias("turn"))
        turns = materialise(turns.where(F.col("kind").isin(DEFINITION, DECLARATION)))
        view = self._view(touched)
        is_def, come = F.col("kind") == DEFINITION, F.col("turn") == 1
        first = lambda on: F.min(F.when(on, F.col("p")))
        step = turns.groupBy("symbol", "bucket").agg(
            F.sum(F.when(is_def, F.col("turn")).otherwise(0)).alias("defs"), F.sum(F.when(is_def, 0).otherwise(F.col("turn"))).alias("decls"),
            first(is_def & come).alias("new_d"), first(~is_def & come).alias("new_c"), first(is_def & ~come).alias("gone_d"), first(~is_def & ~come).alias("gone_c"),
        )
        # no place that goes is before the least one, so the least that goes tells whether this is lost. Each step is written: a task then holds the sorts of one
        old = materialise(step.join(view, "symbol", "left").withColumn("lost", F.coalesce(F.col("gone_d") == F.col("d"), F.lit(False)) | F.coalesce(F.col("gone_c") == F.col("c"), F.lit(False))).drop("gone_d", "gone_c"))
        least = materialise(self._least(old.where("lost").select("symbol"), facts, touched))
        kept = lambda own, new: F.when(F.col(own).isNull(), F.col(new)).when(F.col(new).isNull(), F.col(own)).otherwise(F.least(own, new))
        merged = old.join(least, "symbol", "left").select(
            "symbol", (F.coalesce("n_def", F.lit(0)) + F.col("defs")).cast("bigint").alias("n_def"), (F.coalesce("n_decl", F.lit(0)) + F.col("decls")).cast("bigint").alias("n_decl"),
            F.when(F.col("lost"), F.col("least_d")).otherwise(kept("d", "new_d")).alias("d"), F.when(F.col("lost"), F.col("least_c")).otherwise(kept("c", "new_c")).alias("c"), "bucket",
        )
        for what, rows in (("facts", facts), ("types", types), ("view", merged)):
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{what}/batch={batch}/try={own}")
        self._fs.mkdirs(self._path(f"{self.root}/done"))
        self._fs.create(self._path(f"{self.root}/done/{batch}-{own}")).close()
        return True

    def _view(self, buckets: list[int] | None = None) -> DataFrame:
        """The last row of each symbol."""
        rows = self._log("view", VIEW, buckets)
        return rows.groupBy("symbol").agg(F.max_by(F.struct("n_def", "n_decl", "d", "c"), "batch").alias("x")).select("symbol", "x.*")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*REFERENCE).agg(F.sum("change").alias("n")).where("n > 0").select(*REFERENCE)

    def _least(self, symbols: DataFrame, facts: DataFrame, buckets: list[int]) -> DataFrame:
        """symbol, least_d, least_c of the symbols whose least place went, from their facts; those without any have no row."""
        all_ = self._log("facts", FACT, buckets).select(*REFERENCE, "change").unionByName(facts.select(*REFERENCE, "change")).where(F.col("kind").isin(DEFINITION, DECLARATION))
        live = self._live(all_.join(symbols, "symbol", "left_semi"))
        place = F.struct("file", "line", "start_col", "end_col", "kind")
        return live.groupBy("symbol").agg(F.min(F.when(F.col("kind") == DEFINITION, place)).alias("least_d"), F.min(F.when(F.col("kind") == DECLARATION, place)).alias("least_c"))

    def single(self) -> DataFrame:
        """symbol, n_def, n_decl and the single definition or declaration, as xref.single_definition gives it for symbols with either."""
        pick = F.when(F.col("n_def") == 1, F.col("d")).when((F.col("n_def") == 0) & (F.col("n_decl") == 1), F.col("c"))
        return self._view().where("n_def > 0 OR n_decl > 0").withColumn("p", pick).select("symbol", "n_def", "n_decl", "p.file", "p.line", "p.start_col", "p.end_col", "p.kind")

    def global_definitions(self) -> DataFrame:
        """Live definitions of symbols that have a type which is neither local nor a path."""
        defs = self._live(self._log("facts", FACT).where(F.col("kind") == DEFINITION))
        types = self._log("types", TYPES).groupBy("symbol", "symbol_type").agg(F.sum("change").alias("n")).where("n > 0")
        return defs.join(types.where(~F.col("symbol_type").isin(*LOCAL_TYPES, PATH_TYPE)).select("symbol").distinct(), "symbol", "left_semi").select(*REFERENCE)
