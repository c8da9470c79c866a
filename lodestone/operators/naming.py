"""Symbol names from a forest of declarations.

A name is the path of enclosing scopes and the declaration's own segment. What a
scope adds to the names within it (its segment, and whether names need the file,
or file and offset, before them) is put together along parent pointers by
doubling, so the depth of nesting costs rounds by its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.pointers import LEAST, followed, looked_up
from lodestone.sources.store import materialise

DECLARATIONS = (
    "decl bigint, parent bigint, class string, name string, typedef_name string, file string, offset bigint, canonical bigint, extern_c boolean, external boolean, defining boolean, "
    "explicit boolean, origin bigint, arguments array<string>, parameters array<string>, qualifiers string"
)
#: Bits of what a path asks for before its name.
BY_FILE, BY_OFFSET = 1, 2


def _angled(arguments: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<"), F.array_join(arguments, ", "), F.lit(">")), F.lit(""))


def _joined(near: Column, far: Column) -> Column:
    """far::near; either may be missing."""
    return F.when(near.isNull(), far).when(far.isNull(), near).otherwise(F.concat(far, F.lit("::"), near))


def specialisation_arguments(declarations: DataFrame, least: int = LEAST) -> DataFrame:
    """decl, arguments of class specialisations: an explicit one's own, else those of the nearest explicit one that it was instantiated from, or null."""
    own = declarations.where("class = 'class-specialisation'").select("decl", F.when(~F.coalesce("explicit", F.lit(False)), F.col("origin")).alias("origin"), F.when(F.col("explicit"), F.coalesce("arguments", F.array().cast("array<string>"))).alias("arguments"))
    return followed(own, "decl", "origin", {"arguments": lambda near, far: F.coalesce(near, far)}, least)


def _segments(declarations: DataFrame, least: int) -> DataFrame:
    """decl, scope (its parent), own (segment as a symbol), text (as a scope), asks (as a symbol), asked (as a scope), of each declaration."""
    c, no = F.col, F.lit(False)
    n = declarations.count()
    flag = lambda on, bits: F.when(on, F.lit(bits)).otherwise(F.lit(0))
    # a function's instantiation is named as its pattern; whether it is extern C stands in its first declaration
    pattern = declarations.where("class = 'function'").select(c("decl").alias("pattern"), F.lit(True).alias("_found"), *(c(x).alias(f"_{x}") for x in ("parent", "name", "arguments", "parameters", "qualifiers", "external", "defining")))
    first = declarations.select(c("decl").alias("canonical"), c("extern_c").alias("_first_c"))
    rows = looked_up(declarations.withColumn("pattern", F.when(c("class") == "function", c("origin"))), pattern, "pattern", n, least)
    rows = looked_up(rows, first, "canonical", n, least)
    take = lambda x: F.when(c("_found"), c(f"_{x}")).otherwise(c(x)).alias(x)
    rows = rows.select("decl", "class", "typedef_name", "offset", "extern_c", F.coalesce("_first_c", "extern_c", no).alias("first_c"), *map(take, ("parent", "name", "arguments", "parameters", "qualifiers", "external", "defining")))
    rows = rows.join(specialisation_arguments(declarations, least).withColumnRenamed("arguments", "special"), "decl", "left")
    kind = lambda *names: c("class").isin(*names)
    unnamed = F.concat(F.lit("<unnamed"), c("offset").cast("string"), F.lit(">"))
    tag = F.coalesce("typedef_name", "name", unnamed)
    signature = F.when(c("first_c"), F.lit("")).otherwise(F.concat(F.lit("("), F.array_join(F.coalesce("parameters", F.array().cast("array<string>")), ", "), F.lit(")"), F.coalesce("qualifiers", F.lit(""))))
    own = (
        F.when(kind("namespace"), F.coalesce("name", F.lit("<anon>"))).when(kind("class-specialisation"), F.concat(tag, _angled(c("special")))).when(kind("tag", "enum"), tag)
        .when(kind("function"), F.concat(F.coalesce("name", F.lit("")), _angled(c("arguments")), signature)).otherwise(c("name"))
    )
    by_file = kind("namespace") & c("name").isNull() | kind("variable") & ~F.coalesce("extern_c", no) & ~F.coalesce("external", no) | kind("function") & ~c("first_c") & ~F.coalesce("external", no)
    inside = flag(by_file, BY_FILE).bitwiseOR(flag(kind("function") & F.coalesce("defining", no), BY_FILE | BY_OFFSET))
    return rows.select("decl", "class", c("parent").alias("scope"), own.alias("own"), F.when(~kind("enum"), own).alias("text"), flag(by_file, BY_FILE).alias("asks"), inside.alias("asked"))


def symbol_names(declarations: DataFrame, least: int = LEAST) -> DataFrame:
    """decl, symbol of each declaration that has a name of its own (linkage blocks and unnamed ones that are no tag, namespace or function have none).

    declarations as in DECLARATIONS, one row per decl; parent: the enclosing
    scope, null in a file. A ``linkage`` block is no scope: names in it begin
    there. Rules: an unnamed namespace is <anon> and asks for the file, so do
    variables and functions without external or C linkage; a function's body asks
    for file and offset; enums are left out of the names within them; an unnamed
    tag takes its typedef's name or its offset; arguments stand for explicit
    specialisations only, those of a class followed back through ``origin``; a
    function instantiated from a pattern (origin) is named as that; parameter
    types and qualifiers stand unless the first declaration (canonical) is
    extern C. File and offset are the first declaration's, or the own ones where
    it is missing; without a file nothing is put before.
    """
    c = F.col
    declarations = materialise(declarations)  # read by several joins
    n = declarations.count()
    rows = materialise(_segments(declarations, least))  # scopes and names
    scopes = rows.where("class <> 'linkage'").select("decl", "scope", "text", "asked")
    paths = followed(scopes, "decl", "scope", {"text": _joined, "asked": lambda near, far: near.bitwiseOR(F.coalesce(far, F.lit(0)))}, least)
    inner = rows.where("own IS NOT NULL AND class <> 'linkage'").drop("text", "asked")
    named = looked_up(inner, paths.select(c("decl").alias("scope"), c("text").alias("outer"), "asked"), "scope", n, least)
    named = named.select("decl", _joined(c("own"), c("outer")).alias("path"), c("asks").bitwiseOR(F.coalesce("asked", F.lit(0))).alias("asks"))
    places = declarations.select("decl", "canonical", c("file").alias("own_file"), c("offset").alias("own_offset"))
    places = looked_up(places, declarations.select(c("decl").alias("canonical"), c("file").alias("first_file"), c("offset").alias("first_offset"), F.lit(True).alias("first")), "canonical", n, least)
    at = lambda x: F.when(c("first"), c(f"first_{x}")).otherwise(c(f"own_{x}")).alias(x)
    placed = named.join(places.select("decl", at("file"), at("offset")), "decl")
    base = F.substring_index("file", "/", -1)
    before = F.when(c("asks") == 0, F.lit("")).when(c("asks") >= BY_OFFSET, F.concat(base, F.lit("@"), c("offset").cast("string"), F.lit("/"))).otherwise(F.concat(base, F.lit("/")))
    return placed.select("decl", F.concat(F.coalesce(before, F.lit("")), c("path")).alias("symbol"))
