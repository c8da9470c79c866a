"""A training corpus from documents in five stages.

Every stage takes what its predecessor kept, from Parquet in the shared
folder, so a lost executor costs a stage's tasks at most. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, packing, secrets, toxicity
from lodestone.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the ordinal model finds toxic go; all others stay, whatever their ids."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, that of the smallest id; rows of one id and different texts are documents of their own."""
    return neardup.first_of_classes(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span gives way to a mark; n_chars follows. All documents stay."""
    clean = secrets.redact(docs, secrets.update(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions, in the mix's order; a document stands there up to three times."""
    return mixing.mixed(docs, ordered=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; each source's documents in the order of the mix, which its files keep (a keyed hash where docs comes from no files)."""
    place = F.format_string("%s/%020d", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    try:
        docs.select(place)
    except AnalysisException:
        return packing.pack(docs)
    return packing.pack(docs, order=place)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("secrets", hide_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Stages 1, 2, 4 and 5 are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
