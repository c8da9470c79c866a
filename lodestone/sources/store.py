"""Shared storage: materialised intermediate results and clustered Parquet datasets."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is named and all runs on this machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_clustered(df: DataFrame, path: str, keys: list[str], partitions: int | None = None, compression: str = "snappy") -> None:
    """Write df sorted by keys over range partitions, so that row-group statistics answer key lookups."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.option("compression", compression).mode("errorifexists").parquet(path)


def layout(spark: SparkSession, path: str) -> str:
    """'archive' where a manifest exists, 'index' where tables exist; ValueError for anything else."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, name))
    if has("manifest"):
        return "archive"
    if has("tables"):
        return "index"
    raise ValueError(f"neither an index nor an archive: {path}")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, error of whole text files, new lines normalised, cut at the first NUL."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path"), clean_text(F.col("content").cast("string")).alias("content"), F.when(F.col("content").isNull(), F.lit("cannot open")).alias("error"))


def clean_text(text: Column) -> Column:
    """Carriage returns (with or without a line feed) become line feeds; text ends at the first NUL."""
    return F.substring_index(F.regexp_replace(text, "\r\n?", "\n"), "\u0000", 1)
