"""Deterministic fact views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.arrays import let
from lodestone.operators.classify import EXPRESSION_RULES
from lodestone.operators.trace import encode_pids
from lodestone.sources.store import table


def _case(value: Column, cases: dict, default: str | None = None) -> Column:
    first, *rest = cases.items()
    out = F.when(value == first[0], first[1])
    for k, v in rest:
        out = out.when(value == k, v)
    return out if default is None else out.otherwise(default)


def event_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event is one reference (file, line, start_col, end_col, symbol, kind, symbol_type)."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    start = F.minute("ts").cast("bigint") + 1
    kinds = {"signup": "Definition", "view": "Declaration", "click": "Called", "purchase": "Modified", "error": "Read"}
    types = dict(enumerate(("Class", "Function", "Method", "Field", "LocalVariable", "Parameter")))
    return e.select(
        F.concat(F.lit("@/ev/"), F.date_format("ts", "yyyy-MM-dd")).alias("file"),
        (F.hour("ts").cast("bigint") + 1).alias("line"),
        start.alias("start_col"),
        (start + F.pmod("k", F.lit(7)) + 1).alias("end_col"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("::k"), F.col("k").cast("string")).alias("symbol"),
        _case(F.col("event_type"), kinds).alias("kind"),
        _case(F.pmod("user_id", F.lit(6)), types).alias("symbol_type"),
    )


def line_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order line is one reference: the volume fixture."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    start = F.floor("l_quantity").cast("bigint")
    kinds = {"AF": "Definition", "RF": "Declaration", "NO": "Called"}
    return j.select(
        F.concat(F.lit("@/w/"), F.lower(F.substring("o_orderpriority", 3, 100)), F.lit("/"), F.col("l_orderkey").cast("string")).alias("file"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        start.alias("start_col"),
        (start + 1 + F.pmod("l_partkey", F.lit(5))).alias("end_col"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("symbol"),
        _case(F.concat("l_returnflag", "l_linestatus"), kinds, "Read").alias("kind"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, content."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("@/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", name.alias("file"), F.col("text").alias("content"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths from page addresses: a third below /project, a third absolute, a third relative."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("p"))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/project/"), "p")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), "p")).otherwise(F.col("p"))
    return p.select(path.alias("path")).distinct()


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, u (user), k, event_type, file of events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type", F.concat(F.lit("@/ev/"), F.date_format("ts", "yyyy-MM-dd")).alias("file"))


def expression_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression trees of 400 events each: node, parent, expression, part, is_expression, is_rvalue, is_function."""
    e = numbered_events(spark, sf_dir)
    in_tree, n = F.col("id") % 400, F.pmod(F.col("u") + F.col("k"), F.lit(30))
    of = [("member", "arrow"), *[("member", "dot")] * 3, ("parenthesis", "operand")]
    roles = [(x[0], x[1]) for x in EXPRESSION_RULES] + of
    role = F.get(F.array(*(F.struct(F.lit(a).alias("expression"), F.lit(b).alias("part")) for a, b in roles)), F.least(n, F.lit(len(roles) - 1)).cast("int"))
    parent = F.when(in_tree > 0, F.col("id") - 1 - F.col("k") % F.greatest(F.least(in_tree, F.lit(3)), F.lit(1)))
    return e.select(
        F.col("id").alias("node"), parent.alias("parent"), role["expression"].alias("expression"), role["part"].alias("part"),
        (F.col("k") % 11 != 0).alias("is_expression"), F.col("event_type").isin("click", "error").alias("is_rvalue"), F.when(F.col("id") % 3 == 0, F.col("u") % 4 == 0).alias("is_function"),
    )


def declaration_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations (naming.DECLARATIONS) from events: a forest in each run of 60."""
    e = numbered_events(spark, sf_dir)
    c, i, u, k = F.col, F.col("id"), F.col("u"), F.col("k")
    at, turn, text = i % 60, (i % 12).cast("int"), lambda *xs: F.concat(*(x.cast("string") if x is not None else x for x in xs))
    classes = ["namespace", "namespace", "tag", "tag", "enum", "function", "function", "variable", "class-specialisation", "enumerator", "field", "linkage"]
    kind = F.get(F.array(*map(F.lit, classes)), turn)
    unnamed = turn.isin(1, 11) | (turn == 3) | (turn == 10) & (u % 5 == 0)
    return e.select(
        i.alias("decl"), F.when(at > 0, i - 1 - k % F.greatest(F.least(at, F.lit(4)), F.lit(1))).alias("parent"), F.when((kind == "linkage") & (u % 3 != 0), "typedef").otherwise(kind).alias("class"),
        F.when(~unnamed, text(F.lit("n"), u)).when((turn == 11) & (u % 3 != 0), text(F.lit("t"), u)).alias("name"), F.when((turn == 3) & (u % 2 == 0), text(F.lit("T"), k)).alias("typedef_name"),
        F.when(k % 13 != 0, text(c("file"), F.lit("/f"), u % 7, F.lit(".h"))).alias("file"), (i * 10).alias("offset"), F.when(u % 6 != 0, i - i % 5).alias("canonical"), (k % 7 == 0).alias("extern_c"), (k % 5 == 0).alias("external"),
        (k % 2 == 0).alias("defining"), (k % 3 == 0).alias("explicit"), F.when(turn.isin(5, 6, 8) & (k % 4 != 1) & (at >= 12), i - 12).alias("origin"),
        F.when(turn.isin(8) | (k % 5 == 1), F.when(k % 2 == 0, F.array(F.lit("int"), text(F.lit("A"), k))).otherwise(F.array(text(F.lit("B"), u)))).alias("arguments"),
        F.slice(F.array(F.lit("int"), F.lit("char *"), F.lit("T &")), F.lit(1), (k % 4).cast("int")).alias("parameters"), F.when(k % 4 == 0, F.lit(" const")).alias("qualifiers"),
    )


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


def _ancestry(at: int) -> Column:
    """Processes above a build's record and its own, the highest first."""
    chain = [at - (at % 6 == 5)]
    while chain[0]:
        chain.insert(0, (chain[0] - 1) // 2)
    return F.array(*map(F.lit, chain)).cast("array<bigint>")


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process records from events, a build of 20 each: trace, line, cwd, pidlist, argv.

    Processes of a build are a heap below one shell that writes nothing; every
    sixth record is its predecessor's process again; some parents have no record.
    """
    e = numbered_events(spark, sf_dir)
    i, u, k = F.col("id"), F.col("u"), F.col("k")
    build, at = F.floor(i / 20), i % 20
    known = F.transform(F.coalesce(F.get(F.array(*map(_ancestry, range(20))), at.cast("int")), F.array_compact(F.array(at))), lambda p: F.struct((F.lit(1000) + (build * 20 + p) % 30000).cast("bigint").alias("pid"), (build * 100 + p * 3).cast("bigint").alias("start")))
    between = F.array(F.struct((i % 1000 + 70000).cast("bigint").alias("pid"), (build * 100 + 1).cast("bigint").alias("start")))
    mixed = lambda x: F.concat(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.when(k % 4 == 0, between).otherwise(F.slice(between, 1, 0)), F.slice(x, F.greatest(F.size(x), F.lit(1)), F.lit(1)))
    procs = F.concat(F.array(F.struct(F.lit(1).cast("bigint").alias("pid"), F.lit(0).cast("bigint").alias("start"))), let(known, mixed))
    nothing = F.array().cast("array<string>")
    modes = F.when(k % 5 < 2, F.array(F.lit("-c"))).when(k % 5 == 2, F.array(F.lit("-S"))).when(k % 5 == 3, F.array(F.lit("-E"), F.lit("-c"))).otherwise(F.array(F.lit("-c"), F.lit("-E")))
    output = F.when(u % 4 == 0, F.array(F.lit("-o"), F.concat(F.lit("out/x"), k, F.lit(".o")))).when(u % 4 == 1, F.array(F.lit("-o"), F.concat(F.lit("y"), k, F.lit(".obj")))).when(u % 4 == 2, F.array(F.lit("-o"), F.lit("z"))).otherwise(nothing)
    source = F.concat(F.when(u % 3 == 1, F.lit("/src/")).otherwise(F.lit("")), _pick(["a b.cc", "it's.cpp", "x.c", "start.S", "no_source", "$v.cxx", "pre.c++"], k % 7))
    argv = F.concat(
        F.array(_pick(["/usr/bin/g++", "cc", "make", "clang++", "cc1plus", "gcc", "ld", "sh"], u % 8)), F.when(k % 3 == 0, F.array(F.lit("-include"), F.concat(F.lit("pre"), u % 3, F.lit(".h")))).otherwise(nothing), modes, output,
        F.array(source), F.when(k % 17 == 0, F.array(F.lit("two.cc"))).otherwise(nothing), F.when(k % 19 == 0, F.array(F.lit("-include"))).otherwise(nothing),
    )
    return e.select(
        build.cast("string").alias("trace"), (i + 1).alias("line"), F.when(k % 43 != 0, F.concat(F.lit("/b"), u % 5)).alias("cwd"),
        F.when(k % 41 == 0, F.array().cast("array<bigint>")).when(k % 37 != 0, encode_pids(procs)).alias("pidlist"), F.when(k % 31 == 0, nothing).when(k % 29 != 0, argv).alias("argv"),
    )


def indexing_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, directory, file, argv of the records that have a command line."""
    return trace_records(spark, sf_dir).where("argv IS NOT NULL").select("line", F.col("cwd").alias("directory"), F.coalesce(F.try_element_at("argv", F.lit(-1)), F.lit("e.c")).alias("file"), "argv")


def precompiled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of the files that exist beside headers, from the users of events."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct().where("u % 5 IN (0, 2) AND u % 3 = 1 OR u % 11 = 0")
    return u.select(F.concat(F.lit("/b"), F.col("u") % 5, F.lit("/pre"), F.col("u") % 3, F.when(F.col("u") % 11 == 0, F.lit(".h.txt")).when(F.col("u") % 2 == 0, F.lit(".h.pch")).otherwise(F.lit(".h.gch"))).alias("path")).distinct()
