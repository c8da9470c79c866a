"""Rules that turn attributes of declarations and expressions into facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of the use of an expression.
CALLED, READ, ADDRESS_TAKEN, ASSIGNED, MODIFIED = 1, 2, 4, 8, 16


def reference_kinds(flags: Column, is_function: Column, is_rvalue: Column) -> Column:
    """Kinds of the references that one use makes, as an array."""
    has = lambda bit: flags.bitwiseAND(bit) != 0
    kind = lambda on, name: F.when(on, F.lit(name))
    function = F.array(kind(has(CALLED), "Called"), kind(~has(CALLED) | has(READ | ADDRESS_TAKEN), "AddressTaken"))
    other = F.array(
        kind(has(CALLED), "Called"), kind(has(READ), "Read"), kind(has(ADDRESS_TAKEN), "AddressTaken"), kind(has(ASSIGNED), "Assigned"), kind(has(MODIFIED), "Modified"),
        F.when(flags == 0, F.when(is_rvalue, F.lit("Read")).otherwise(F.lit("Other"))),
    )
    return F.array_compact(F.when(is_function, function).otherwise(other))


def rvalue_flags(flags: Column) -> Column:
    """An rvalue's use can neither take an address nor assign or modify."""
    return flags.bitwiseAND(CALLED | READ)


def member_base_flags(flags: Column, is_arrow: Column) -> Column:
    """Use of the object of a member access: an arrow reads it; a dot hands on what the member's use means for the whole."""
    to = lambda on, bit: F.when(on, F.lit(bit)).otherwise(F.lit(0))
    has = lambda bit: flags.bitwiseAND(bit) != 0
    dot = to(has(ADDRESS_TAKEN), ADDRESS_TAKEN) + to(has(ASSIGNED | MODIFIED), MODIFIED) + to(has(READ | CALLED), READ)
    return F.when(is_arrow, F.lit(READ)).otherwise(dot)


# What the parts of an expression are used for; inherit keeps the whole's use, set bits are added to it.
EXPRESSION_RULES = [
    ("call", "callee", 0, CALLED), ("call", "argument", 0, ADDRESS_TAKEN), ("comma", "left", 0, 0), ("comma", "right", 1, 0), ("assign", "left", 1, ASSIGNED),
    ("assign", "right", 0, 0), ("compound-assign", "left", 1, MODIFIED), ("compound-assign", "right", 0, 0), ("cast-array-to-pointer", "operand", 0, ADDRESS_TAKEN), ("cast-to-void", "operand", 0, 0), ("cast-lvalue-to-rvalue", "operand", 0, READ),
    ("address-of", "operand", 0, ADDRESS_TAKEN), ("dereference", "operand", 0, 0), ("parenthesis", "operand", 1, 0), ("declaration", "initialiser", 0, ADDRESS_TAKEN),
    ("return", "operand", 0, ADDRESS_TAKEN), ("list", "item", 0, ADDRESS_TAKEN),
]


def operand_flags(uses: DataFrame) -> DataFrame:
    """uses (expression, part, flags of the whole) with part_flags, by the rule table; in assignments a call's result counts as read."""
    rules = uses.sparkSession.createDataFrame(EXPRESSION_RULES, "expression string, part string, inherit int, added int")
    whole = F.when(F.col("expression").isin("assign", "compound-assign") & (F.col("flags").bitwiseAND(CALLED) != 0), F.col("flags").bitwiseAND(~CALLED).bitwiseOR(READ)).otherwise(F.col("flags"))
    joined = uses.join(F.broadcast(rules), ["expression", "part"])  # a fixed table
    return joined.withColumn("part_flags", F.when(F.col("inherit") == 1, whole).otherwise(F.lit(0)).bitwiseOR(F.col("added"))).drop("inherit", "added")


def qualifiers(symbol: Column) -> Column:
    """The leading segments of a qualified name, without the name itself."""
    parts = F.split(symbol, "::", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def span_end(start_line: Column, start: Column, end_line: Column, end: Column) -> Column:
    """End column of a reference: on one line at least the start, on several the start; an empty span gets one column."""
    e = F.when(start_line == end_line, F.greatest(start, end)).otherwise(start)
    return F.when(e == start, start + 1).otherwise(e)


# Declaration class, then (kind where it defines, kind where it doesn't, symbol type, of the declaration's target instead); null kinds are left out.
DECLARATION_RULES = [
    ("instantiated-function", None, None, None, False), ("constructor", "Definition", "Declaration", "Constructor", False), ("destructor", "Definition", "Declaration", "Destructor", False),
    ("method", "Definition", "Declaration", "Method", False), ("function", "Definition", "Declaration", "Function", False), ("parameter", "Definition", None, "Parameter", False),
    ("global-variable", "Definition", "Declaration", "GlobalVariable", False), ("local-variable", "Definition", "Declaration", "LocalVariable", False),
    ("struct", "Definition", "Declaration", "Struct", False), ("class", "Definition", "Declaration", "Class", False), ("union", "Definition", "Declaration", "Union", False),
    ("enum", "Definition", "Declaration", "Enum", False), ("interface", "Definition", "Declaration", "Interface", False), ("using-directive", "Using-Directive", "Using-Directive", None, False),
    ("using-declaration", "Using", "Using", None, False), ("namespace-alias", "Declaration", "Declaration", "Namespace", False), ("namespace-alias", "Namespace-Alias", "Namespace-Alias", None, True), ("function-template", None, None, None, False), ("class-template", None, None, None, False),
    ("field", "Declaration", "Declaration", "Field", False), ("typedef", "Declaration", "Declaration", "Typedef", False), ("namespace", "Declaration", "Declaration", "Namespace", False),
    ("enumerator", "Declaration", "Declaration", "Enumerator", False), ("macro", "Definition", "Definition", "Macro", False), ("include", "Included", "Included", "Path", False),
]
# Forms of types that make a reference, and the kinds outside and inside a list of bases.
TYPE_FORMS = ("tag", "typedef", "template-parameter", "record-specialisation")
TYPE_KINDS = ("Reference", "Base-Class")


def declaration_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECLARATION_RULES, "class string, defining_kind string, other_kind string, symbol_type string, of_target boolean")


def declaration_facts(declarations: DataFrame) -> DataFrame:
    """declarations (class, name, target, defining, ...) with kind and symbol_type; unnamed and omitted ones go, an unknown class declares without a type.

    A rule of the target (an alias's namespace) makes a fact of its own, whose name is the target.
    """
    rules = declaration_rules(declarations.sparkSession)
    kind = F.when(F.col("_known").isNull(), F.lit("Declaration")).when(F.col("defining"), F.col("defining_kind")).otherwise(F.col("other_kind"))
    joined = declarations.join(F.broadcast(rules.withColumn("_known", F.lit(True))), "class", "left")  # a fixed table
    named = joined.withColumn("kind", kind).withColumn("name", F.when(F.col("of_target"), F.col("target")).otherwise(F.col("name")))
    return named.where("kind IS NOT NULL AND name IS NOT NULL").drop("defining_kind", "other_kind", "of_target", "target", "_known")


def initializer_facts(initializers: DataFrame) -> DataFrame:
    """Constructor initializers (member, ...) as facts: a named member is Initialized; one of a base (null member) makes none."""
    return initializers.where("member IS NOT NULL").withColumnRenamed("member", "symbol").withColumn("kind", F.lit("Initialized"))


def type_facts(types: DataFrame) -> DataFrame:
    """Written types (form, symbol, in_bases, ...) as facts: the symbol's Base-Class in a definition's list of bases, else a Reference; other forms make none."""
    kind = F.when(F.col("in_bases"), F.lit(TYPE_KINDS[1])).otherwise(F.lit(TYPE_KINDS[0]))
    return types.where(F.col("form").isin(*TYPE_FORMS) & F.col("symbol").isNotNull()).withColumn("kind", kind).drop("form", "in_bases")


def include_facts(includes: DataFrame) -> DataFrame:
    """Includes (file, line, start_col, end_col, found, target) as facts: those whose target wasn't found make none; a target without a path is <blank>."""
    symbol = F.concat(F.lit("@"), F.when(F.coalesce("target", F.lit("")) == "", F.lit("<blank>")).otherwise(F.col("target")))
    return includes.where("found").select("file", "line", "start_col", "end_col", symbol.alias("symbol"), F.lit("Included").alias("kind"), F.lit("Path").alias("symbol_type"))


def scoped_name(scopes: Column, name: Column, typedef_name: Column, arguments: Column, offset: Column) -> Column:
    """Scopes and name joined by ::. scopes: array<struct<name, enum>>; enums are left out. An unnamed tag takes its typedef's name; arguments: of an explicit specialisation, null for none."""
    own = F.concat(F.coalesce(name, typedef_name, F.concat(F.lit("<unnamed"), offset.cast("string"), F.lit(">"))), F.coalesce(F.concat(F.lit("<"), F.array_join(arguments, ", "), F.lit(">")), F.lit("")))
    outer = F.transform(F.filter(scopes, lambda s: ~s["enum"]), lambda s: F.coalesce(s["name"], F.lit("<anon>")))
    return F.array_join(F.concat(outer, F.array(own)), "::")


def function_signature(extern_c: Column, parameters: Column, qualifier: Column) -> Column:
    """Parameter types and qualifiers after a function's name; none where its first declaration is extern C."""
    return F.when(extern_c, F.lit("")).otherwise(F.concat(F.lit("("), F.array_join(parameters, ", "), F.lit(")"), F.coalesce(qualifier, F.lit(""))))


def symbol_name(scopes: Column, name: Column, file: Column, offset: Column, in_function: Column, internal: Column, parameters: Column, qualifier: Column) -> Column:
    """Name of a symbol: scopes and name joined by ::, parameter types for functions, a file prefix for what only its file sees.

    scopes: enclosing names, null for an anonymous namespace; name: null for an
    unnamed tag; in_function: declared inside a function, which adds the offset;
    parameters: canonical types, null for no function; qualifier: " const" and the like.
    """
    anonymous = F.exists(scopes, lambda s: s.isNull())
    base = F.substring_index(file, "/", -1)
    prefix = F.when(in_function, F.concat(base, F.lit("@"), offset.cast("string"), F.lit("/"))).when(internal | anonymous, F.concat(base, F.lit("/"))).otherwise(F.lit(""))
    own = F.coalesce(name, F.concat(F.lit("<unnamed"), offset.cast("string"), F.lit(">")))
    path = F.array_join(F.concat(F.transform(scopes, lambda s: F.coalesce(s, F.lit("<anon>"))), F.array(own)), "::")
    signature = F.when(parameters.isNull(), F.lit("")).otherwise(F.concat(F.lit("("), F.array_join(parameters, ", "), F.lit(")"), F.coalesce(qualifier, F.lit(""))))
    return F.concat(prefix, path, signature)


def macro_facts(macros: DataFrame) -> DataFrame:
    """macros (file, line, col, name, event) as facts: the symbol is #name, the span the name's."""
    kind = F.when(F.col("event") == "define", F.lit("Definition")).when(F.col("event") == "undef", F.lit("Undefinition")).when(F.col("event").isin("defined", "ifdef", "ifndef"), F.lit("Defined-Test")).otherwise(F.lit("Expansion"))
    return macros.select("file", "line", F.col("col").alias("start_col"), (F.col("col") + F.octet_length("name")).alias("end_col"), F.concat(F.lit("#"), "name").alias("symbol"), kind.alias("kind"), F.lit("Macro").alias("symbol_type"))


def widened_span(line_text: Column, start: Column, name: Column) -> Column:
    """struct<start, end> (bytes, from 1) of a name on its line, with a destructor's tilde or the operator keyword before it."""
    before = F.substring(line_text.cast("binary"), F.lit(1), (start - 1).cast("int")).cast("string")
    lead = F.regexp_extract(before, "(~|\\boperator)[ \\t]*$", 0)
    return F.struct((start - F.octet_length(lead)).cast("bigint").alias("start"), (start + F.octet_length(name)).cast("bigint").alias("end"))
