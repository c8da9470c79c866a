"""Registered source-facts queries; their DuckDB equivalents stand in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import regex
from lodestone.operators import classify, dictionary, history, merge, report, syntax, tables, text, trace, tree, xref
from lodestone.operators.snapshots import Snapshots
from lodestone.plans import forests, indexes
from lodestone.plans.oracle import ORACLE_SQL
from lodestone.schema import REFERENCE
from lodestone.sources.facts import document_files, event_refs, indexing_commands, line_refs, numbered_events, page_paths, precompiled_headers, trace_records
from lodestone.sources.store import materialise, shared_dir, table
from lodestone.streaming import processes


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SYMBOL = "u1::k1"
FILE = "@/ev/2024-01-05"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _busy(facts: DataFrame) -> DataFrame:
    """The symbol with the most references, as a one-row table."""
    return facts.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(1).select("symbol")


# --- cross-reference ------------------------------------------------------


@query
def refs_of_symbol(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    return xref.refs_of_symbols(facts, _busy(facts))


@query
def refs_of_missing_symbol(s: SparkSession, d: str) -> DataFrame:
    return xref.refs_of_symbol(event_refs(s, d), "no such symbol").agg(F.count("*").alias("n"))


@query
def refs_of_symbol_report(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    rows = xref.refs_of_symbols(facts, _busy(facts))
    out = report.Report("References", ("file", "line", "kind"), report.numbered(rows, ["file", "line", "start_col", "end_col", "kind"]))
    return out.sorted("kind").select("position", "file", "line", "kind")


@query
def file_refs_range(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    first = facts.agg(F.min("file").alias("file"))
    return xref.refs_of_files(facts, first, 5, 12)


@query
def prefix_lower_bound(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    return tables.lower_bound(facts, ["symbol", "file", "line", "start_col", "end_col", "kind"], ["u5"])


@query
def reverse_scan_topk(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    last = facts.orderBy(*[F.desc(c) for c in REFERENCE]).limit(25)
    return last.withColumn("position", F.row_number().over(W.orderBy(*[F.desc(c) for c in REFERENCE])).cast("bigint"))


@query
def all_paths(s: SparkSession, d: str) -> DataFrame:
    return dictionary.ranked(xref.all_paths(event_refs(s, d)), ["path"])


@query
def all_symbols(s: SparkSession, d: str) -> DataFrame:
    return dictionary.ranked(xref.all_symbols(event_refs(s, d)), ["symbol"])


@query
def single_definition(s: SparkSession, d: str) -> DataFrame:
    return xref.single_definition(event_refs(s, d))


@query
def single_definition_path(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    wanted = facts.select(F.col("file").alias("symbol")).unionByName(facts.select("symbol")).unionByName(s.createDataFrame([("@/zz",)], "symbol string"))
    return xref.definitions_of(facts, wanted)


@query
def global_definitions(s: SparkSession, d: str) -> DataFrame:
    return xref.global_definitions(event_refs(s, d))


@query
def non_local_filter(s: SparkSession, d: str) -> DataFrame:
    return tables.global_symbols(tables.symbol_rows(event_refs(s, d)))


@query
def first_definition(s: SparkSession, d: str) -> DataFrame:
    return xref.first_definition(line_refs(s, d))


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Event facts where every symbol of an even k has a second type, and those of k = 0 have none."""
    facts = event_refs(s, d)
    k = F.regexp_extract("symbol", "k([0-9]+)$", 1).cast("bigint")
    second = facts.where(k % 2 == 0).withColumn("symbol_type", F.lit("Macro"))
    return facts.unionByName(second).withColumn("symbol_type", F.when(k != 0, F.col("symbol_type")))


@query
def symbol_types(s: SparkSession, d: str) -> DataFrame:
    return xref.symbol_types(_typed(s, d))


@query
def symbols_report(s: SparkSession, d: str) -> DataFrame:
    return report.symbol_report(xref.symbol_types(_typed(s, d))).sorted("symbol_type").select("position", "symbol", "symbol_type")


@query
def files_report(s: SparkSession, d: str) -> DataFrame:
    return report.file_report(xref.all_paths(event_refs(s, d))).sorted("path").select("position", "path")


@query
def defs_report_sorted_desc(s: SparkSession, d: str) -> DataFrame:
    return report.definition_report(xref.global_definitions(event_refs(s, d))).sorted("file", descending=True).select("position", "symbol", "file")


@query
def report_page(s: SparkSession, d: str) -> DataFrame:
    return report.definition_report(xref.global_definitions(event_refs(s, d))).page("symbol", 100, 50).select("position", "symbol", "file")


def _filtered(s: SparkSession, d: str, pattern: str) -> DataFrame:
    rows = xref.all_symbols(event_refs(s, d)).select(F.col("symbol"), F.lit(0).alias("source_row"))
    return report.Report("Symbols", ("symbol",), rows).filter(pattern).rows.select("symbol")


@query
def report_regex_filter_smartcase_lower(s: SparkSession, d: str) -> DataFrame:
    return document_files(s, d).where(regex.report_filter(F.col("content"), "^(the|der) a")).select("doc_id")


@query
def report_regex_filter_smartcase_upper(s: SparkSession, d: str) -> DataFrame:
    return document_files(s, d).where(regex.report_filter(F.col("content"), "^(The|Der) a")).select("doc_id")


@query
def report_regex_filter_symbols(s: SparkSession, d: str) -> DataFrame:
    return _filtered(s, d, "k(7|9)$")


@query
def report_filter_empty(s: SparkSession, d: str) -> DataFrame:
    return _filtered(s, d, "")


@query
def report_column_widths(s: SparkSession, d: str) -> DataFrame:
    return report.Report("Global Definitions", ("symbol", "file"), xref.global_definitions(event_refs(s, d))).widths().select(F.col("symbol").alias("w_symbol"), F.col("file").alias("w_file"))


def _points(facts: DataFrame) -> DataFrame:
    """Every start and the column after it, as points."""
    own = facts.select("file", "line", F.col("start_col").alias("col"))
    return own.unionByName(own.withColumn("col", F.col("col") + 1)).distinct()


@query
def point_in_span_best(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    return xref.point_in_span(facts, _points(facts))


@query
def symbols_at_span(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    return xref.symbols_at_span(facts, facts.select("file", "line", "start_col", "end_col")).withColumn("symbols", F.array_join("symbols", ","))


@query
def click_to_definition(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    return xref.click_to_definition(facts, _points(facts))


@query
def span_end_rule(s: SparkSession, d: str) -> DataFrame:
    li = line_refs(s, d)
    end_line = F.col("line") + F.when(F.col("start_col") % 7 == 0, 1).otherwise(0)
    end = F.col("end_col") - 4
    return li.select("file", "line", "start_col", classify.span_end(F.col("line"), F.col("start_col"), end_line, end).alias("end_col")).distinct()


# --- dictionaries and tables ----------------------------------------------


@query
def dict_encode(s: SparkSession, d: str) -> DataFrame:
    return dictionary.encode(event_refs(s, d), "symbol")


@query
def dict_decode_roundtrip(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select("file", "line", "symbol").distinct()
    ids = dictionary.encode(facts, "symbol")
    coded = facts.join(ids.withColumnRenamed("value", "symbol"), "symbol").select("file", "line", F.col("id").alias("symbol_id"))
    return dictionary.decode(coded, ids, "symbol_id", "symbol").select("file", "line", "symbol_id", "symbol")


@query
def dict_lookup(s: SparkSession, d: str) -> DataFrame:
    ids = dictionary.encode(event_refs(s, d), "kind")
    return dictionary.lookup(ids, "Called").unionByName(dictionary.lookup(ids, "Missing"))


@query
def table_distinct(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select(*REFERENCE)
    return tables.distinct_rows(facts.unionByName(facts))


@query
def merge_indexes(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    day = F.dayofmonth(F.substring("file", 6, 10).try_cast("date"))
    even, odd = facts.where(day % 2 == 0), facts.where(day % 3 != 0)
    index = merge.merge_indexes(even, odd)
    return index.tables["Reference"]


@query
def merge_id_map(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    old = dictionary.encode(facts.where(F.dayofmonth(F.substring("file", 6, 10).try_cast("date")) % 2 == 0), "symbol")
    return dictionary.id_map(old, dictionary.encode(facts, "symbol")).select("old_id", "new_id")


@query
def invert_reference(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    order = ["symbol", "kind", "file", "line", "start_col", "end_col"]
    return dictionary.ranked(tables.invert(facts, order), order, "position")


@query
def invert_symbol(s: SparkSession, d: str) -> DataFrame:
    symbols = tables.symbol_rows(event_refs(s, d))
    return dictionary.ranked(tables.invert(symbols, ["symbol_type", "symbol"]), ["symbol_type", "symbol"], "position")


@query
def archive_manifest(s: SparkSession, d: str) -> DataFrame:
    return merge.entry_hashes(event_refs(s, d))


@query
def archive_dedup(s: SparkSession, d: str) -> DataFrame:
    entries = document_files(s, d).select(F.sha2("content", 256).alias("hash"), "doc_id", "file")
    return merge.first_of_hash(entries, ["doc_id"])


@query
def archive_open_entry(s: SparkSession, d: str) -> DataFrame:
    """An archive is written to the shared folder and one entry read back."""
    path = f"{shared_dir(s)}/archive-{uuid.uuid4().hex}"
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    merge.write_archive(facts, path)
    name = merge.open_archive(s, path).agg(F.min("name").alias("name")).first()["name"] or ""
    return merge.open_entry(s, path, name).select(*REFERENCE)


@query
def archive_merge(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    half = facts.where("line < 12").select(F.lit("b").alias("archive"), F.col("file").alias("entry"), "*")
    both = facts.select(F.lit("a").alias("archive"), F.col("file").alias("entry"), "*").unionByName(half)
    hashes = merge.entry_hashes(facts).select(F.lit("a").alias("archive"), F.col("name").alias("entry"), "hash")
    return merge.merge_archives(hashes.unionByName(hashes.withColumn("archive", F.lit("b"))), both)


@query
def catalog_stats(s: SparkSession, d: str) -> DataFrame:
    return merge.catalog_stats(tables.build_index(event_refs(s, d)))


@query
def dump_denormalized(s: SparkSession, d: str) -> DataFrame:
    return tables.build_index(event_refs(s, d)).decoded("Reference")


@query
def index_type_lookup(s: SparkSession, d: str) -> DataFrame:
    return tables.build_index(event_refs(s, d)).decoded("SymbolTypeIndex").where(F.col("type") == "Path")


@query
def vle_row_size(s: SparkSession, d: str) -> DataFrame:
    li = line_refs(s, d)
    scaled = [F.col("line"), F.col("start_col") * 3000, F.length("file") * 400_000]
    return li.groupBy(tables.row_width(scaled).alias("bytes")).agg(F.count("*").alias("n"))


@query
def incremental_stale(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d)
    entries = facts.select(F.concat(F.lit("idx"), (F.col("line") % 5).cast("string")).alias("index_file"), F.lit(20).cast("bigint").alias("index_mtime"), F.col("file").alias("name")).distinct()
    entries = entries.where("index_file <> 'idx3' OR name < '@/ev/2024-01-10'").unionByName(entries.limit(0)).unionByName(s.createDataFrame([("idx3", 20, "<built-in>"), ("none", None, "@/zz")], "index_file string, index_mtime bigint, name string"))
    mtimes = facts.select(F.col("file").alias("name"), F.dayofmonth(F.substring("file", 6, 10).try_cast("date")).cast("bigint").alias("mtime")).distinct()
    return merge.reusable(entries, mtimes)


# --- text -----------------------------------------------------------------


@query
def line_table(s: SparkSession, d: str) -> DataFrame:
    return text.lines(document_files(s, d))


@query
def offset_to_line(s: SparkSession, d: str) -> DataFrame:
    files = document_files(s, d)
    offsets = files.select("file", F.explode(F.array(F.lit(0), F.lit(57), F.lit(311)).cast("array<bigint>")).alias("offset"), F.octet_length("content").alias("n")).where("offset <= n").drop("n")
    return text.offset_to_line(files, offsets)


@query
def location_to_offset(s: SparkSession, d: str) -> DataFrame:
    rows = text.lines(document_files(s, d))
    return text.location_to_offset(rows, rows.select("file", "line", F.lit(40).cast("bigint").alias("col")))


@query
def longest_line(s: SparkSession, d: str) -> DataFrame:
    return text.longest_line(document_files(s, d))


@query
def tab_expanded_length(s: SparkSession, d: str) -> DataFrame:
    """Lines of all files, with a tab for each blank."""
    lines = text.lines(document_files(s, d)).select(F.translate("text", " ", "\t").alias("line")).distinct()
    return lines.select("line", text.tab_width(F.col("line")).alias("width"))


@query
def word_at_position(s: SparkSession, d: str) -> DataFrame:
    rows = text.lines(document_files(s, d))
    return text.words_at(rows, rows.select("file", "line", F.explode(F.array(F.lit(0), F.lit(9), F.lit(23)).cast("array<bigint>")).alias("col")))


@query
def find_in_file_matches(s: SparkSession, d: str) -> DataFrame:
    return text.matches(document_files(s, d), "the[a-z]* of")


@query
def find_longest_matches(s: SparkSession, d: str) -> DataFrame:
    """The longer alternative counts, wherever it stands."""
    return text.matches(document_files(s, d), "the|[[:alpha:]]+ of|the[a-z]* of")


@query
def match_next_prev(s: SparkSession, d: str) -> DataFrame:
    return text.next_previous(text.matches(document_files(s, d), "the[a-z]* of"))


def _states(files: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).cast("bigint").alias("find_start"), F.lit(b).cast("bigint").alias("previous")) for a, b in ((-1, -1), (200, -1), (100, 400), (600, 300), (0, 10**9))])
    return files.select("file", F.explode(pairs).alias("s")).select("file", "s.*")


@query
def match_best_index(s: SparkSession, d: str) -> DataFrame:
    files = document_files(s, d)
    return text.best_match(text.matches(files, "the[a-z]* of"), _states(files))


@query
def match_label(s: SparkSession, d: str) -> DataFrame:
    found = text.matches(document_files(s, d), "the[a-z]* of").groupBy("file").agg(F.count("*").alias("n"))
    per = document_files(s, d).select("file").join(found, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n"))
    picked = F.when(F.col("n") > 3, F.lit(2)).otherwise(F.lit(-1))
    return per.select("file", text.match_label(F.lit("x"), F.col("n"), picked).alias("label"))


@query
def syntax_kinds(s: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_kinds(document_files(s, d))


@query
def color_overlay(s: SparkSession, d: str) -> DataFrame:
    """Colours column by column, from runs."""
    runs = syntax.colour_overlay(event_refs(s, d))
    return runs.select("file", "line", F.explode(F.sequence("start", F.col("end") - 1)).alias("col"), "colour")


@query
def colour_runs(s: SparkSession, d: str) -> DataFrame:
    return syntax.colour_overlay(event_refs(s, d))


@query
def keyword_lookup(s: SparkSession, d: str) -> DataFrame:
    words = document_files(s, d).select(F.explode(F.split("content", "[^A-Za-z0-9_]+")).alias("word"))
    return words.where(F.col("word").isin(*sorted(syntax.KEYWORDS))).groupBy("word").agg(F.count("*").alias("n"))


@query
def directive_kinds(s: SparkSession, d: str) -> DataFrame:
    """Kinds of texts made of directives, comments and quotations, fifty lines of events each."""
    e, c = numbered_events(s, d), F.col
    made = ["#if X", " # define Y 1", "#include <a b.h>", "x #if 2", "#pragma once", "#nothing here", "// note \\", "/* open", "closed */ #else", "'c' \"s\" 1.5e+3", "#include_next \t<x", "int y; // #endif", "#  import <z>"]
    line = F.get(F.array(*map(F.lit, made)), ((c("k") + c("u")) % len(made)).cast("int"))
    lines = e.groupBy(F.floor(c("id") / 50).cast("string").alias("file")).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    return syntax.syntax_kinds(lines.select("file", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content")))


# --- trees ----------------------------------------------------------------


@query
def path_categories(s: SparkSession, d: str) -> DataFrame:
    return page_paths(s, d).select("path", tree.category(F.col("path")).alias("category"))


@query
def path_tree(s: SparkSession, d: str) -> DataFrame:
    return tree.nodes(page_paths(s, d))


@query
def folder_auto_expand(s: SparkSession, d: str) -> DataFrame:
    return tree.auto_expanded(tree.nodes(page_paths(s, d)))


@query
def tree_preorder(s: SparkSession, d: str) -> DataFrame:
    return tree.preorder(tree.nodes(page_paths(s, d))).select("row", "category", "path", "is_file", "last")


@query
def tree_visible(s: SparkSession, d: str) -> DataFrame:
    t = tree.nodes(page_paths(s, d))
    return tree.visible(t, tree.auto_expanded(t).unionByName(t.where("depth = 1 AND NOT is_file").select("category", "path"))).select("category", "path")


@query
def tree_roots(s: SparkSession, d: str) -> DataFrame:
    return tree.roots(tree.nodes(page_paths(s, d)))


# --- history, traces, rules -----------------------------------------------


def _sessions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    action = F.when(F.col("event_type") == "error", "back").when(F.col("event_type") == "signup", "forward").otherwise("jump")
    return e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.col("event_id").alias("seq"), action.alias("action"), F.get_json_object("props", "$.k").alias("place"), F.when(F.col("event_type") == "click", F.concat(F.lit("o"), F.get_json_object("props", "$.k"))).alias("origin"))


@query
def history_fold(s: SparkSession, d: str) -> DataFrame:
    return history.fold(_sessions(s, d))


def _trace(s: SparkSession, d: str) -> DataFrame:
    """Process records as a trace has them, in files: the expressions that make them from events are not planned again for each use."""
    return materialise(trace_records(s, d))


@query
def trace_delta_decode(s: SparkSession, d: str) -> DataFrame:
    return trace.decode_pids(_trace(s, d)).select("line", F.posexplode("procs").alias("pos", "p")).select("line", F.col("pos").cast("bigint").alias("pos"), "p.pid", "p.start")


@query
def trace_delta_encode(s: SparkSession, d: str) -> DataFrame:
    again = trace.decode_pids(_trace(s, d)).select("line", F.posexplode(trace.encode_pids(F.col("procs"))).alias("pos", "delta"))
    return again.select("line", F.col("pos").cast("bigint").alias("pos"), "delta")


@query
def trace_parent(s: SparkSession, d: str) -> DataFrame:
    return trace.parents(_trace(s, d))


@query
def trace_driver_child(s: SparkSession, d: str) -> DataFrame:
    return trace.below_driver(_trace(s, d))


@query
def trace_compile_steps(s: SparkSession, d: str) -> DataFrame:
    return trace.compile_steps(_trace(s, d))


@query
def compile_db_paths(s: SparkSession, d: str) -> DataFrame:
    return trace.indexing_jobs(indexing_commands(s, d)).withColumn("argv", F.array_join("argv", " "))


@query
def pch_strip(s: SparkSession, d: str) -> DataFrame:
    jobs = trace.strip_precompiled(indexing_commands(s, d), precompiled_headers(s, d))
    return jobs.select("line", "directory", F.array_join("argv", " ").alias("argv"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    return numbered_events(s, d).select((F.col("k") % 32).cast("int").alias("flags"), (F.col("u") % 2 == 0).alias("is_function"), (F.col("id") % 3 == 0).alias("is_rvalue")).distinct()


@query
def expr_ref_kinds(s: SparkSession, d: str) -> DataFrame:
    return _flags(s, d).withColumn("kind", F.explode(classify.reference_kinds(F.col("flags"), F.col("is_function"), F.col("is_rvalue"))))


@query
def member_flags(s: SparkSession, d: str) -> DataFrame:
    rows = _flags(s, d).select("flags", F.col("is_function").alias("is_arrow")).distinct()
    return rows.withColumn("base", classify.member_base_flags(F.col("flags"), F.col("is_arrow"))).withColumn("masked", classify.rvalue_flags(F.col("flags")))


@query
def operand_flags(s: SparkSession, d: str) -> DataFrame:
    uses = _flags(s, d).select("flags").distinct().withColumn("u", F.explode(F.array(*[F.struct(F.lit(e).alias("expression"), F.lit(p).alias("part")) for e, p, _, _ in classify.EXPRESSION_RULES])))
    return classify.operand_flags(uses.select("flags", "u.*")).select("expression", "part", "flags", "part_flags")


@query
def qualifier_segments(s: SparkSession, d: str) -> DataFrame:
    facts = event_refs(s, d).select("symbol").distinct()
    rows = facts.select("symbol", F.posexplode(classify.qualifiers(F.col("symbol"))).alias("pos", "qualifier"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def symbol_names(s: SparkSession, d: str) -> DataFrame:
    e, c = numbered_events(s, d), F.col
    scopes = F.slice(F.array(F.concat(F.lit("n"), c("u")), F.when(c("u") % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("mid")), F.concat(F.lit("s"), c("k"))), F.lit(1), (c("k") % 4).cast("int"))
    parameters = F.when(c("k") % 5 != 0, F.slice(F.array(F.lit("int"), F.lit("char *")), F.lit(1), (c("k") % 3).cast("int")))
    own = F.when(c("k") % 8 != 0, F.concat(F.lit("f"), c("u")))
    return e.select("id", classify.symbol_name(scopes, own, F.concat("file", F.lit("/f.h")), c("id"), c("u") % 3 == 0, c("u") % 2 == 0, parameters, F.when(c("k") % 7 == 0, " const")).alias("symbol"))


@query
def declaration_facts(s: SparkSession, d: str) -> DataFrame:
    """Declarations of every class, of unknown ones and of none, from events."""
    e, c = numbered_events(s, d), F.col
    classes = sorted({r[0] for r in classify.DECLARATION_RULES}) + ["label", None]
    turn = F.get(F.array(*(F.lit(x) for x in classes)), ((c("u") * 7 + c("k")) % len(classes)).cast("int"))
    rows = e.select("id", turn.alias("class"), F.when(c("k") % 9 != 0, F.concat(F.lit("d"), c("u"))).alias("name"), F.when(c("k") % 4 != 0, F.concat(F.lit("N"), c("k"))).alias("target"), (c("id") % 2 == 0).alias("defining"))
    return classify.declaration_facts(rows)


@query
def scoped_names(s: SparkSession, d: str) -> DataFrame:
    e, c = numbered_events(s, d), F.col
    scope = lambda name, enum: F.struct(name.alias("name"), enum.alias("enum"))
    scopes = F.slice(F.array(scope(F.concat(F.lit("n"), c("u")), F.lit(False)), scope(F.lit("Colour"), c("u") % 2 == 0), scope(F.when(c("u") % 3 != 0, "in"), F.lit(False))), F.lit(1), (c("k") % 4).cast("int"))
    own = classify.scoped_name(scopes, F.when(c("k") % 5 != 0, F.concat(F.lit("f"), c("u"))), F.when(c("k") % 10 == 0, "T"), F.when(c("k") % 6 == 0, F.array(F.lit("int"), F.concat(F.lit("A"), c("k")))), c("id"))
    return e.select("id", F.concat(own, classify.function_signature(c("k") % 3 == 0, F.slice(F.array(F.lit("int"), F.lit("T &")), F.lit(1), (c("u") % 3).cast("int")), F.when(c("k") % 7 == 0, " const"))).alias("symbol"))


@query
def type_facts(s: SparkSession, d: str) -> DataFrame:
    e, c = numbered_events(s, d), F.col
    form = F.get(F.array(*map(F.lit, (*classify.TYPE_FORMS, "builtin", "auto"))), (c("k") % 6).cast("int"))
    return classify.type_facts(e.select("id", form.alias("form"), F.when(c("u") % 7 != 0, F.concat(F.lit("t"), c("u"))).alias("symbol"), (c("u") % 2 == 0).alias("in_bases")))


@query
def initializer_facts(s: SparkSession, d: str) -> DataFrame:
    e, c = numbered_events(s, d), F.col
    return classify.initializer_facts(e.select("id", F.when(c("k") % 5 != 0, F.concat(F.lit("C"), c("u"), F.lit("::m"), c("k"))).alias("member")))


@query
def include_facts(s: SparkSession, d: str) -> DataFrame:
    e, c = numbered_events(s, d), F.col
    target = F.when(c("k") % 6 == 1, "").when(c("k") % 6 != 0, F.concat(F.lit("/i/h"), c("u"), F.lit(".h")))
    return classify.include_facts(e.select("file", c("id").alias("line"), (c("k") + 1).alias("start_col"), (c("k") + 9).alias("end_col"), (c("k") % 4 != 0).alias("found"), target.alias("target")))


@query
def volume_definitions(s: SparkSession, d: str) -> DataFrame:
    """The volume fixture: definitions and declarations of every part."""
    return xref.single_definition(line_refs(s, d)).select("symbol", "n_def", "n_decl")


@query
def volume_point_lookup(s: SparkSession, d: str) -> DataFrame:
    li = line_refs(s, d).withColumn("symbol_type", F.lit("Class"))
    return xref.point_in_span(li, li.select("file", "line", F.col("start_col").alias("col")))


# --- smaller operators ----------------------------------------------------


@query
def command_split(s: SparkSession, d: str) -> DataFrame:
    """Command lines as the trace quotes them, and with double quotes, backslashes and blanks."""
    records = _trace(s, d).where("argv IS NOT NULL")
    k = F.size("pidlist")
    dressed = F.concat(F.lit('"'), F.regexp_replace(F.get("argv", F.lit(0)), "c", r"\\c"), F.lit(r'"  -DX=\"'), k, F.lit(r"""\" \ 'it'\''s' """), F.lit('""z'))
    rows = records.select("line", F.when(F.col("line") % 3 == 0, dressed).otherwise(trace.quote(F.col("argv"))).alias("command"))
    rows = rows.withColumn("argv", trace.split_command(F.col("command")))
    return rows.select("line", F.array_join("argv", "|").alias("argv"), F.size("argv").cast("bigint").alias("n"))


@query
def widened_spans(s: SparkSession, d: str) -> DataFrame:
    """Names with a tilde, an operator keyword, a longer word or nothing before them."""
    e, c = numbered_events(s, d), F.col
    name = F.when(c("k") % 5 == 1, "==").otherwise(F.concat(F.lit("F"), c("u")))
    blanks = F.repeat(F.lit(" "), (c("u") % 7).cast("int"))
    lead = F.when(c("k") % 5 == 0, "x ~").when(c("k") % 5 == 1, "bool operator  ").when(c("k") % 5 == 2, "é ~ ").when(c("k") % 5 == 3, "myoperator ").otherwise(blanks)
    rows = e.select("id", F.concat(lead, name, F.lit("();")).alias("line"), (F.octet_length(lead) + 1).alias("at"), name.alias("name"))
    return rows.withColumn("x", classify.widened_span(F.col("line"), F.col("at"), F.col("name"))).select("id", "x.start", "x.end")


@query
def range_text(s: SparkSession, d: str) -> DataFrame:
    """The second and the third line of every file, by their bytes."""
    files = document_files(s, d)
    at = text.lines(files).where("line IN (1, 2)").groupBy("file").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("len")).alias("last"))
    return files.join(at, "file").select("file", text.range_text(F.col("content"), F.col("first"), F.col("last")).alias("text"))


@query
def char_widths(s: SparkSession, d: str) -> DataFrame:
    rows = text.lines(document_files(s, d))
    return text.char_widths(rows).groupBy("file", "line", "n", "is_word").agg(F.count("*").alias("chars"), F.max("col").alias("last"))


@query
def refs_with_text(s: SparkSession, d: str) -> DataFrame:
    """Each match with the line it begins on."""
    files = document_files(s, d)
    found = text.matches(files, "the[a-z]* of").select("file", "idx", F.col("start").alias("offset"))
    at = text.offset_to_line(files, found.select("file", "offset"))
    refs = found.join(at, ["file", "offset"]).select("file", (F.col("line") + 1).alias("line"), "idx")
    return xref.with_text(refs, text.lines(files))


@query
def file_colours(s: SparkSession, d: str) -> DataFrame:
    """Every file coloured by kinds of text and, over them, by references: each match of a pattern is one, of a type by its number."""
    files = document_files(s, d)
    kind = F.element_at(F.array(F.lit("Class"), F.lit("Macro"), F.lit("Function")), (F.col("idx") % 3 + 1).cast("int"))
    spans = text.matches(files, "the[a-z]* of").select("file", "start", (F.col("start") + F.col("len")).alias("end"), syntax.colour(kind).alias("colour"), F.col("idx").alias("seq"))
    return syntax.file_colours(files, spans)


@query
def syntax_pieces(s: SparkSession, d: str) -> DataFrame:
    """Kinds of texts put together twenty ids at a time by language, read in small pieces: the same as in one go."""
    docs = table(s, d, "documents").where("text IS NOT NULL").groupBy("lang", F.floor(F.col("doc_id") / 20).alias("part"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    files = docs.agg(F.array_join(texts, "\n").alias("content")).select(F.concat_ws("/", "lang", "part").alias("file"), "content")
    return syntax.syntax_kinds(files, size=2000)


@query
def symbols_report_view(s: SparkSession, d: str) -> DataFrame:
    """A report sorted by its second column, filtered, and with its columns' widths."""
    view = report.symbol_report(xref.symbol_types(_typed(s, d))).filter("k[1-3]$")
    widths = view.widths().select(F.col("symbol").alias("w_symbol"), F.col("symbol_type").alias("w_type"))
    return view.sorted("symbol_type", descending=True).select("position", "symbol", "symbol_type").join(F.broadcast(widths))  # one row


@query
def references_at_span(s: SparkSession, d: str) -> DataFrame:
    """References of every symbol that stands at a definition's span of the first file."""
    facts = event_refs(s, d)
    first = facts.agg(F.min("file").alias("file"))
    spans = facts.where("kind = 'Definition'").join(F.broadcast(first), "file", "left_semi").select("file", "line", "start_col", "end_col")  # one row
    return xref.references_at(facts, spans)


@query
def index_project(s: SparkSession, d: str) -> DataFrame:
    """An archive of half-known entries is refreshed: fresh entries stay as they are, files changed since (day above 20) are indexed anew, in a version of their own."""
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    names = facts.select(F.col("file").alias("name")).distinct()
    store = Snapshots(s, f"{shared_dir(s)}/project-{uuid.uuid4().hex}")
    store.refresh(facts.where("line < 12"), names.select(F.col("name").alias("entry")), "first")
    day = F.dayofmonth(F.substring("name", 6, 10).try_cast("date")).cast("bigint")
    known = names.select(F.col("name").alias("index_file"), F.lit(20).cast("bigint").alias("index_mtime"), "name")
    stale = merge.reusable(known, names.withColumn("mtime", day)).where("NOT reusable").select(F.col("index_file").alias("entry"))
    store.refresh(facts.join(stale.withColumnRenamed("entry", "file"), "file", "left_semi"), stale, "second")
    return store.facts()


@query
def trace_to_compile_db(s: SparkSession, d: str) -> DataFrame:
    """A trace's files are read in order, its compile steps are written as a database, and that is read again."""
    base = f"{shared_dir(s)}/trace-{uuid.uuid4().hex}"
    _trace(s, d).orderBy("line").select("cwd", "pidlist", "argv").write.option("ignoreNullFields", False).json(f"{base}/trace")
    trace.write_compile_db(trace.compile_steps(trace.read_trace(s, f"{base}/trace")), f"{base}/db", many=50)
    db = trace.read_compile_db(s, f"{base}/db")
    return db.select("directory", "file", F.array_join(trace.split_command(F.col("command")), "|").alias("argv"))


@query
def trace_stream_parents(s: SparkSession, d: str) -> DataFrame:
    """The trace as a stream of files: parents and drivers above each record, from the state kept between them."""
    base = f"{shared_dir(s)}/processes-{uuid.uuid4().hex}"
    records = _trace(s, d)
    records.write.parquet(f"{base}/in")
    with processes.map_state(s):
        stream = processes.ancestry_stream(s.readStream.schema(records.schema).parquet(f"{base}/in"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return s.read.schema(processes.RESULT).parquet(f"{base}/out").select("line", "parent", F.coalesce("driver", F.lit(False)).alias("driver"), "below")


@query
def match_backgrounds(s: SparkSession, d: str) -> DataFrame:
    found = text.matches(document_files(s, d), "the[a-z]* of").select("file", "start", (F.col("start") + F.col("len")).alias("end"), F.when(F.col("idx") == 1, "hover").when(F.col("idx") == 2, "selection").otherwise("match").alias("what"))
    wider = found.where("what = 'selection'").withColumn("start", F.greatest(F.col("start") - 40, F.lit(0)))
    return text.backgrounds(found.unionByName(wider)).groupBy("file", "what").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.min("start").alias("first"))


@query
def tree_open_all(s: SparkSession, d: str) -> DataFrame:
    t = tree.nodes(page_paths(s, d))
    return tree.open_all(t, t.where("is_file AND depth > 2").select("category", "path"))


@query
def archive_entry_position(s: SparkSession, d: str) -> DataFrame:
    manifest = merge.entry_hashes(event_refs(s, d))
    return merge.entry_position(manifest, "@/ev/2024-01-05").unionByName(merge.entry_position(manifest, "@/zz"))


@query
def archive_dump(s: SparkSession, d: str) -> DataFrame:
    return merge.archive_stats(event_refs(s, d))


@query
def report_batches(s: SparkSession, d: str) -> DataFrame:
    rows = report.file_report(xref.all_symbols(event_refs(s, d)).withColumnRenamed("symbol", "path")).rows
    return report.batches(rows, rows.count()).groupBy("batch").agg(F.count("*").alias("n"))


@query
def canonical_files(s: SparkSession, d: str) -> DataFrame:
    files = document_files(s, d).select(F.col("doc_id").alias("id"), F.sha2("content", 256).alias("real_path"))
    return text.canonical_files(files)


@query
def macro_facts(s: SparkSession, d: str) -> DataFrame:
    names = {"signup": "define", "view": "ifdef", "click": "expand", "purchase": "undef", "error": "defined"}
    e = table(s, d, "events")
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    macros = e.select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.hour("ts").cast("bigint").alias("line"), F.minute("ts").cast("bigint").alias("col"), F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("name"), F.try_element_at(event, "event_type").alias("event"))
    return classify.macro_facts(macros)


QUERIES |= forests.QUERIES | indexes.QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
