"""Build traces: process records to compile commands, and compile commands to indexing jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.arrays import let, running_sum
from lodestone.operators.dictionary import ranked
from lodestone.operators.pointers import followed, looked_up
from lodestone.schema import TRACE
from lodestone.sources.store import materialise

# Compiler drivers, extensions and modes that the trace reader knows.
DRIVERS = ("cc", "c++", "gcc", "g++", "clang", "clang++")
SOURCE_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".c++")
ASSEMBLY_EXTENSIONS = (".s", ".S")
MODES = ("-c", "-S", "-E")
SAFE_ARGUMENT = "^[^*?\\[\\]'\"\\\\$;&()|^<>\\s!#~`]+$"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """line (order of the records), cwd, pidlist, argv of a JSON-lines trace."""
    where = F.col("_metadata")
    rows = spark.read.schema(TRACE).json(path).select("*", where["file_path"].alias("_f"), where["file_block_start"].alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return ranked(rows, ["_f", "_b", "_i"], "line").drop("_f", "_b", "_i")  # a file's splits may be read in any order


def decode_pids(records: DataFrame) -> DataFrame:
    """records with procs array<struct<pid, start>>: the running sums of the flattened (pid, start) deltas; empty for an empty or null list."""
    pairs = F.floor(F.coalesce(F.size("pidlist"), F.lit(0)) / 2).cast("int")
    at = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    sums = lambda k: running_sum(F.transform(at, lambda i: F.get("pidlist", i * 2 + k)), 1)
    return records.withColumn("procs", F.zip_with(sums(0), sums(1), lambda pid, start: F.struct(pid.alias("pid"), start.alias("start"))))


def encode_pids(procs: Column) -> Column:
    """The flattened deltas of an array of (pid, start), which is made once."""
    back = lambda xs, p, i, f: p[f] - F.when(i > 0, F.get(xs, i - 1)[f]).otherwise(0)
    return F.flatten(let(procs, lambda xs: F.transform(xs, lambda p, i: F.array(back(xs, p, i, "pid"), back(xs, p, i, "start")))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_driver(argv: Column) -> Column:
    return basename(F.get(argv, F.lit(0))).isin(*DRIVERS)


def parents(records: DataFrame) -> DataFrame:
    """line, parent: the record of the nearest ancestor known when the line was written; of several records of a process the last one before it.

    A process's own records are one row, so an ancestor that most records name
    (a shell) is looked up, not joined pair by pair. Runs an action.
    """
    d = materialise(decode_pids(records).select("line", "procs"))
    own = d.select("line", F.try_element_at("procs", F.lit(-1)).alias("p")).where("p IS NOT NULL").groupBy("p").agg(F.collect_set("line").alias("own"))
    up = d.select("line", F.posexplode(F.slice("procs", F.lit(1), F.greatest(F.size("procs") - 1, F.lit(0)))).alias("depth", "p"))
    hit = looked_up(up, own, "p", up.count()).where("own IS NOT NULL").withColumn("parent", F.array_max(F.filter("own", lambda x: x < F.col("line")))).where("parent IS NOT NULL")
    return hit.groupBy("line").agg(F.max(F.struct("depth", "parent")).alias("b")).select("line", F.col("b.parent").alias("parent"))


def below_driver(records: DataFrame) -> DataFrame:
    """line of every record with a compiler driver among its ancestors.

    Pointers are doubled, so the rounds are the logarithm of the deepest chain.
    """
    edges = parents(records)
    flags = records.select(F.col("line").alias("parent"), F.coalesce(is_driver(F.col("argv")), F.lit(False)).alias("driver"))
    state = edges.join(flags, "parent").select("line", F.col("parent").alias("up"), F.col("driver").alias("below"))
    found = followed(state, "line", "up", {"below": lambda near, far: near | F.coalesce(far, F.lit(False))})
    return found.where("below").select("line")


def _ends(arg: Column, extensions: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(arg, F.lit(e))
    return out


def compile_mode(argv: Column) -> Column:
    """The last mode argument, null without one."""
    return F.try_element_at(F.filter(argv, lambda a: a.isin(*MODES)), F.lit(-1))


def quote(argv: Column) -> Column:
    """A shell command line: unsafe arguments in single quotes."""
    return F.array_join(F.transform(argv, lambda a: F.when(a.rlike(SAFE_ARGUMENT), a).otherwise(F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("'\\''")), F.lit("'")))), " ")


def compile_steps(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """line, directory, command, file of the records that compile exactly one source file.

    existing (path): files known to exist; None takes all as existing.
    """
    rest = F.filter(F.slice("argv", F.lit(2), F.greatest(F.size("argv") - 1, F.lit(0))), lambda a: ~F.startswith(a, F.lit("-")))
    sources = F.filter(rest, lambda a: _ends(a, SOURCE_EXTENSIONS))
    steps = records.where(is_driver(F.col("argv")) & (compile_mode(F.col("argv")) == "-c"))
    steps = steps.where((F.size(sources) == 1) & ~F.exists(rest, lambda a: _ends(a, ASSEMBLY_EXTENSIONS)))
    steps = steps.join(below_driver(records), "line", "left_anti").select("line", F.col("cwd").alias("directory"), quote(F.col("argv")).alias("command"), F.get(sources, F.lit(0)).alias("file"))
    if existing is None:
        return steps
    known = existing.select(F.col("path").alias("_path"))
    return steps.withColumn("_path", absolute(F.col("directory"), F.col("file"))).join(known, "_path", "left_semi").drop("_path")


def write_compile_db(steps: DataFrame, path: str, many: int = 10_000) -> None:
    """Files that hold a JSON array of at most many commands each, in the order of the trace."""
    rows = ranked(steps.select("line", "directory", "command", "file"), ["line"], "_pos").withColumn("_block", F.floor(F.col("_pos") / many))
    each = F.array_sort(F.collect_list(F.struct("_pos", F.struct("directory", "command", "file").alias("c"))))
    text = rows.groupBy("_block").agg(F.to_json(F.transform(each, lambda x: x["c"])).alias("value"))
    text.repartitionByRange("_block").sortWithinPartitions("_block").select("value").write.option("maxRecordsPerFile", 1).text(path)


def absolute(cwd: Column, path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", cwd, path))


def read_compile_db(spark: SparkSession, path: str) -> DataFrame:
    """A compile database (one or more files with a JSON array each)."""
    return spark.read.schema("directory string, command string, file string, arguments array<string>").option("multiLine", True).json(path)


def split_command(command: Column) -> Column:
    """argv of a shell command line: quotes group, a backslash takes the next character as it is (not within single quotes)."""
    parts = F.regexp_extract_all(command, F.lit("(?:'[^']*'|\"(?:\\\\.|[^\"\\\\])*\"|\\\\.|[^\\s'\"\\\\])+"), F.lit(0))
    pieces = lambda a: F.regexp_extract_all(a, F.lit("'[^']*'|\"(?:\\\\.|[^\"\\\\])*\"|\\\\.|[^'\"\\\\]+"), F.lit(0))
    inner = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    plain = lambda p: F.when(F.startswith(p, F.lit("'")), inner(p)).otherwise(F.regexp_replace(F.when(F.startswith(p, F.lit('"')), inner(p)).otherwise(p), "\\\\(.)", "$1"))
    return F.transform(parts, lambda a: F.array_join(F.transform(pieces(a), plain), ""))


def indexing_jobs(commands: DataFrame) -> DataFrame:
    """directory, source, argv (driver replaced), index_path of commands (directory, file, argv).

    The index stands where the first object after -o would, else beside the
    working directory under the source's name.
    """
    argv = F.col("argv")
    driver = F.when(F.endswith(F.get(argv, F.lit(0)), F.lit("++")), F.lit("clang++")).otherwise(F.lit("clang"))
    outputs = F.filter(F.transform(argv, lambda a, i: F.when((a == "-o") & (F.endswith(F.get(argv, i + 1), F.lit(".o")) | F.endswith(F.get(argv, i + 1), F.lit(".obj"))), F.get(argv, i + 1))), lambda x: x.isNotNull())
    source = absolute(F.col("directory"), F.col("file"))
    named = F.regexp_replace(basename(source), "\\.[^.]*$", ".idx")
    target = F.coalesce(F.regexp_replace(F.try_element_at(outputs, F.lit(1)), "\\.[^.]*$", ".idx"), named)
    return commands.select(
        "directory", source.alias("source"),
        F.when(F.size(argv) > 0, F.concat(F.array(driver), F.slice(argv, F.lit(2), F.size(argv)))).otherwise(argv).alias("argv"),
        absolute(F.col("directory"), target).alias("index_path"),
    )


def strip_precompiled(jobs: DataFrame, precompiled: DataFrame) -> DataFrame:
    """jobs (directory, argv, ...) without the -include pairs whose header has a precompiled file.

    precompiled (path): existing .pch, .pth and .gch files. A last -include without a value stays.
    """
    argv = F.col("argv")

    def pair(acc: Column, a: Column) -> Column:
        opens = (a == "-include") & ~acc["open"]
        return F.struct(F.concat(acc["out"], F.array(F.struct(a.alias("arg"), acc["open"].alias("value")))).alias("out"), opens.alias("open"))

    marked = F.aggregate(argv, F.struct(F.array().cast("array<struct<arg:string,value:boolean>>").alias("out"), F.lit(False).alias("open")), pair, lambda acc: acc["out"])
    rows = jobs.withColumn("_job", F.monotonically_increasing_id()).withColumn("_m", marked)
    rows = materialise(rows)
    values = rows.select("_job", "directory", F.explode(F.filter("_m", lambda x: x["value"])).alias("x")).select("_job", F.col("x.arg").alias("header"), absolute(F.col("directory"), F.col("x.arg")).alias("path")).distinct()
    stems = precompiled.select(F.regexp_replace("path", "\\.(pch|pth|gch)$", "").alias("path")).distinct()
    drop = values.join(stems, "path", "left_semi").groupBy("_job").agg(F.collect_set("header").alias("_drop"))
    out = rows.join(drop, "_job", "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<string>")))
    gone = lambda i: F.get("_m", i)["value"] & F.array_contains("_drop", F.get("_m", i)["arg"])
    kept = F.filter("_m", lambda x, i: ~(gone(i) | F.coalesce(gone(i + 1), F.lit(False))))
    return out.withColumn("argv", F.transform(kept, lambda x: x["arg"])).drop("_job", "_m", "_drop")


__all__ = ["absolute", "below_driver", "compile_steps", "decode_pids", "encode_pids", "indexing_jobs", "parents", "quote", "read_compile_db", "read_trace", "split_command", "strip_precompiled", "write_compile_db"]
