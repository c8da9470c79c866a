"""Path trees: categories, folders, automatic expansion and pre-order layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dictionary import ranked
from lodestone.operators.pointers import looked_up

#: Sorts before every character of a title, so that a folder's children follow it directly.
_CUT = "\u0001"


def category(path: Column, root: str = "/project") -> Column:
    """Project below the root, External for other absolute paths, else Special."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.lit("Project")).when(F.startswith(path, F.lit("/")), F.lit("External")).otherwise(F.lit("Special"))


def relative(path: Column, root: str = "/project") -> Column:
    """The path below its category."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))).when(F.startswith(path, F.lit("/")), F.substring(path, F.lit(2), F.length(path))).otherwise(path)


def title(path: Column) -> Column:
    """Text after the last slash; empty where the path ends in one."""
    return F.substring_index(path, "/", -1)


def nodes(paths: DataFrame, root: str = "/project") -> DataFrame:
    """category, path, parent, title, depth, is_file of every file and folder; folders are the files' prefixes, once each."""
    parts = F.split(relative(F.col("path"), root), "/", -1)
    rows = paths.select(category(F.col("path"), root).alias("category"), parts.alias("p")).distinct()
    each = rows.select("category", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", F.lit(1), i), "/").alias("path"), i.alias("depth"), (i == F.size("p")).alias("is_file"), F.array_join(F.slice("p", F.lit(1), i - 1), "/").alias("parent")))).alias("n"))
    out = each.select("category", "n.path", "n.parent", F.col("n.depth").cast("bigint").alias("depth"), "n.is_file").distinct()
    return out.withColumn("title", title(F.col("path")))


def child_counts(tree: DataFrame) -> DataFrame:
    """category, parent, folders, files."""
    return tree.groupBy("category", "parent").agg(F.count_if(~F.col("is_file")).alias("folders"), F.count_if("is_file").alias("files"))


def auto_expanded(tree: DataFrame) -> DataFrame:
    """category, path of folders that are the only thing in their parent."""
    single = child_counts(tree).where("folders = 1 AND files = 0").select("category", "parent")
    return tree.where("NOT is_file").join(single, ["category", "parent"], "left_semi").select("category", "path")


def sort_key(path: Column, is_file: Column) -> Column:
    """Pre-order key: folders before files on each level, then by title."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.when((i == n - 1) & is_file, F.lit("f")).otherwise(F.lit("d")), x)), _CUT)


def preorder(tree: DataFrame) -> DataFrame:
    """tree with row (0-based place in the flattened tree) and last (whether no sibling follows). Runs an action."""
    ends = tree.groupBy(F.struct("category", "parent").alias("_at")).agg(F.max(F.struct("is_file", "title")).alias("_end"))
    placed = looked_up(tree.withColumn("_at", F.struct("category", "parent")), ends, "_at", tree.count())
    flagged = placed.withColumn("last", F.struct("is_file", "title") == F.col("_end")).drop("_at", "_end")
    order = F.when(F.col("category") == "Project", 0).when(F.col("category") == "External", 1).otherwise(2)
    return ranked(flagged.withColumns({"_c": order, "_k": sort_key(F.col("path"), F.col("is_file"))}), ["_c", "_k"], "row").drop("_c", "_k")


def roots(tree: DataFrame) -> DataFrame:
    """Categories that are shown: Project always, the others where they hold anything."""
    spark = tree.sparkSession
    always = spark.createDataFrame([("Project",)], "category string")
    return tree.select("category").unionByName(always).distinct()


def visible(tree: DataFrame, opened: DataFrame) -> DataFrame:
    """Nodes all of whose ancestors are open. opened: category, path; the category itself is open."""
    ancestors = tree.select("category", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/", -1)) - 1), lambda i: F.array_join(F.slice(F.split("path", "/", -1), F.lit(1), i), "/"))).alias("folder")).where("folder <> ''")
    shut = ancestors.join(opened.select("category", F.col("path").alias("folder")), ["category", "folder"], "left_anti").select("category", "path").distinct()
    return tree.join(shut, ["category", "path"], "left_anti")


def ancestors(path: Column) -> Column:
    """All folders above a path, the outermost first."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def open_all(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """category, path of the folders to open so that all chosen (category, path) show."""
    return chosen.select("category", F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(tree.where("NOT is_file").select("category", "path"), ["category", "path"], "left_semi")
