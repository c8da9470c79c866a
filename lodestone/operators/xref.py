"""Cross-reference queries over decoded facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.tables import global_symbols, symbol_rows
from lodestone.schema import DECLARATION, DEFINITION, PATH_TYPE, REFERENCE
from lodestone.sources.store import materialise

#: Columns to a stretch of a line in point lookups; a power of two, 64 at most.
STRETCH = 32


def refs_of_symbol(facts: DataFrame, symbol: str) -> DataFrame:
    """Distinct references of one symbol; none for an unknown symbol."""
    return facts.where(F.col("symbol") == symbol).select(*REFERENCE).distinct()


def refs_of_symbols(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct references of several symbols (symbol)."""
    return facts.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select(*REFERENCE).distinct()


def refs_of_files(facts: DataFrame, files: DataFrame, first: int = 0, last: int = (1 << 31) - 1) -> DataFrame:
    """Distinct references on lines first to last of several files (file)."""
    return facts.where(F.col("line").between(first, last)).join(files.select("file").distinct(), "file", "left_semi").select(*REFERENCE).distinct()


def file_refs(facts: DataFrame, file: str, first: int = 0, last: int = (1 << 31) - 1) -> DataFrame:
    return facts.where((F.col("file") == file) & F.col("line").between(first, last)).select(*REFERENCE).distinct()


def all_paths(facts: DataFrame) -> DataFrame:
    """Paths without their leading sign."""
    return symbol_rows(facts).where(F.col("symbol_type") == PATH_TYPE).select(F.expr("substring(symbol, 2)").alias("path")).distinct()


def all_symbols(facts: DataFrame) -> DataFrame:
    return facts.select("symbol").unionByName(facts.select(F.col("file").alias("symbol"))).distinct()


def single_definition(facts: DataFrame) -> DataFrame:
    """symbol, n_def, n_decl and the one definition, or the one declaration of a symbol without definition; nulls where neither is single.

    A symbol that is a path is its own place (line 1, columns 1 to 1, no kind).
    """
    refs = facts.select(*REFERENCE).distinct()
    place = F.struct("file", "line", "start_col", "end_col", "kind")
    is_def, is_decl = F.col("kind") == DEFINITION, F.col("kind") == DECLARATION
    per = refs.groupBy("symbol").agg(
        F.count_if(is_def).alias("n_def"), F.count_if(is_decl).alias("n_decl"), F.min(F.when(is_def, place)).alias("d"), F.min(F.when(is_decl, place)).alias("c")
    )
    pick = F.when(F.col("n_def") == 1, F.col("d")).when((F.col("n_def") == 0) & (F.col("n_decl") == 1), F.col("c"))
    return per.withColumn("p", pick).select("symbol", "n_def", "n_decl", "p.file", "p.line", "p.start_col", "p.end_col", "p.kind")


def definitions_of(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The place to jump to for each wanted symbol: a path itself if it exists, else the single definition, else none."""
    paths = facts.select(F.col("file").alias("symbol")).distinct()
    wanted = wanted.select("symbol").distinct()
    own = wanted.join(paths, "symbol", "left_semi")
    one = F.lit(1).cast("bigint")
    itself = own.select("symbol", F.col("symbol").alias("file"), one.alias("line"), one.alias("start_col"), one.alias("end_col"), F.lit(None).cast("string").alias("kind"))
    named = wanted.join(paths, "symbol", "left_anti")
    found = single_definition(facts.join(named, "symbol", "left_semi")).where("file IS NOT NULL").drop("n_def", "n_decl")
    return itself.unionByName(found)


def global_definitions(facts: DataFrame) -> DataFrame:
    """Definitions of symbols that are not local."""
    wanted = global_symbols(symbol_rows(facts))
    return facts.where(F.col("kind") == DEFINITION).select(*REFERENCE).distinct().join(wanted, "symbol", "left_semi").select(*REFERENCE)


def symbol_types(facts: DataFrame) -> DataFrame:
    """Each symbol of facts with its last type in order, null without one."""
    types = facts.where("symbol_type IS NOT NULL").groupBy("symbol").agg(F.max("symbol_type").alias("symbol_type"))
    return facts.select("symbol").distinct().join(types, "symbol", "left")


def covers(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (at < end)


def point_in_span(facts: DataFrame, points: DataFrame) -> DataFrame:
    """The innermost reference at each point (file, line, col): latest start, then earliest end, then symbol and kind order.

    A span stands in each stretch of STRETCH columns that it touches, the points
    of a stretch are one mask of its columns; so a point meets the spans near it,
    not all of a long line. Both are dealt by file, line and stretch, once: masks
    are made and spans meet them there, and the best of each point is taken there.
    Repeated references don't change a least one, so none are sought.
    """
    c, bits = F.col, STRETCH.bit_length() - 1
    stretch, at = lambda x: F.shiftright(x.cast("bigint"), bits), lambda x: F.pmod(x, F.lit(STRETCH)).cast("int")
    masks = points.withColumn("_s", stretch(c("col"))).groupBy("file", "line", "_s").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at(c("col")))).alias("_mask"))
    refs = facts.select(*REFERENCE).where("end_col > start_col").withColumn("_s", F.explode(F.sequence(stretch(c("start_col")), stretch(c("end_col") - 1))))
    first = F.shiftleft("_s", bits)
    inside = F.sequence(F.greatest(c("start_col"), first), F.least(c("end_col") - 1, first + STRETCH - 1))
    hit = masks.join(refs, ["file", "line", "_s"]).withColumn("col", F.explode(F.filter(inside, lambda x: F.call_function("getbit", c("_mask"), at(x)) == 1)))
    best = F.min(F.struct((-c("start_col")).alias("later"), "end_col", "symbol", "kind")).alias("b")
    return hit.groupBy("file", "line", "_s", "col").agg(best).select("file", "line", c("col").cast(points.schema["col"].dataType).alias("col"), (-c("b.later")).alias("start_col"), "b.end_col", "b.symbol", "b.kind")


def symbols_at_span(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Sorted distinct symbols of the references that have exactly the span (file, line, start_col, end_col)."""
    hit = facts.join(spans.distinct(), ["file", "line", "start_col", "end_col"], "left_semi")
    return hit.groupBy("file", "line", "start_col", "end_col").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def click_to_definition(facts: DataFrame, points: DataFrame) -> DataFrame:
    """Where a click at each point (file, line, col) leads: its innermost span must hold exactly one symbol.

    The facts are made distinct and written once, for the five passes over them.
    """
    facts = materialise(facts.select(*REFERENCE).distinct())
    spans = materialise(point_in_span(facts, points).select("file", "line", "col", "start_col", "end_col"))
    symbols = symbols_at_span(facts, spans.drop("col")).where(F.size("symbols") == 1).withColumn("symbol", F.get("symbols", F.lit(0))).drop("symbols")
    at = spans.join(symbols, ["file", "line", "start_col", "end_col"]).select("file", "line", "col", "symbol")
    to = definitions_of(facts, at).select("symbol", F.col("file").alias("to_file"), F.col("line").alias("to_line"), F.col("start_col").alias("to_col"))
    return at.join(to, "symbol").select("file", "line", "col", "symbol", "to_file", "to_line", "to_col")


def first_definition(facts: DataFrame) -> DataFrame:
    """The first definition of each symbol in reference order."""
    best = F.min(F.struct("file", "line", "start_col", "end_col", "kind")).alias("b")
    return facts.where(F.col("kind") == DEFINITION).groupBy("symbol").agg(best).select("b.file", "b.line", "b.start_col", "b.end_col", "symbol", "b.kind")


def references_at(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every reference to any symbol of each span (file, line, start_col, end_col), as at_file, at_line, at_start, at_end and the reference."""
    at = symbols_at_span(facts, spans).select(F.col("file").alias("at_file"), F.col("line").alias("at_line"), F.col("start_col").alias("at_start"), F.col("end_col").alias("at_end"), F.explode("symbols").alias("symbol"))
    return at.join(facts.select(*REFERENCE).distinct(), "symbol").select("at_file", "at_line", "at_start", "at_end", *REFERENCE)


def with_text(refs: DataFrame, line_rows: DataFrame) -> DataFrame:
    """refs (line from 1) with the text of their line; line_rows count from 0."""
    return refs.join(line_rows.select("file", (F.col("line") + 1).alias("line"), "text"), ["file", "line"])
