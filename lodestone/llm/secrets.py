"""Secret scanning with an incremental, content-addressed blob ledger.

Every version of a path is addressed by the SHA-256 of its text. The ledger
holds one row per blob: which rule versions have scanned it and the spans they
found. ``update`` scans only the (blob, rule version) pairs that the ledger
lacks; ``findings`` joins a ledger back to every path that holds a blob. ``scan_in_turn`` takes versions batch by batch, writes the ledger
after each and reads it again for the next.

Everything runs in built-in functions. A blob is moved once per map task that
holds it (the grouping combines copies before the shuffle). The join back is
salted, so a blob that makes up much of the table is spread over many tasks.
The work for a text grows with its length and its number of matches.

Edge cases: a null text is the empty blob; an empty table gives an empty
ledger and no findings; rows that repeat are each returned; extra columns of
the input are ignored, whatever their names; a ledger entry of another rule
version counts as not scanned and stays in the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrays import let, running
from lodestone.llm.common import written
from lodestone.llm.spans import matches

SALTS = 32
#: start and end in code points, from and to in bytes.
SPANS = "array<struct<start:int,end:int,from:int,to:int>>"


@dataclass(frozen=True)
class Rule:
    """pattern matches candidates; group must have least characters at least."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The patterns of the contract, then public token formats.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (
    Rule("assign", ASSIGN, 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scans(text: Column, rules: tuple[Rule, ...], done: Column | None = None) -> Column:
    """map<rule@version, SPANS> of one text, without the rules whose keys done (an array) has. One expression serves all rules, so the plan doesn't grow with them."""
    each = F.array(*[F.struct(F.lit(r.key).alias("key"), F.lit(r.pattern).alias("pattern"), F.lit(r.least).alias("least"), F.lit(r.group).alias("group")) for r in rules])
    if done is not None:
        each = F.filter(each, lambda r: ~F.array_contains(done, r["key"]))

    def spans(r: Column) -> Column:
        long = F.filter(matches(text, r["pattern"]), lambda x: (r["least"] == 0) | (F.length(F.call_function("regexp_extract", x["m"], r["pattern"], r["group"])) >= r["least"]))
        return F.struct(r["key"].alias("key"), F.transform(long, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "from", "to")])).alias("value"))

    return F.map_from_entries(F.transform(each, spans))


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger after scanning versions: blob string, found map<rule@version, spans>; new rows are written to the shared folder.

    ledger is an earlier result (or None). Pairs that it holds are not scanned again.
    """
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).groupBy(F.sha2("_text", 256).alias("blob")).agg(F.any_value("_text").alias("_text"))
    if ledger is None:
        return written(blobs.select("blob", scans(F.col("_text"), rules).alias("found")))
    done = ledger.select("blob", F.map_keys("found").alias("_done"))
    complete = done.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), "_done")) == 0)
    blobs = blobs.join(complete, "blob", "left_anti")
    old = ledger.select("blob", F.col("found").alias("_old"))
    blobs = blobs.join(old, "blob", "left").withColumn("_old", F.coalesce("_old", F.create_map().cast(f"map<string,{SPANS}>")))
    fresh = scans(F.col("_text"), rules, F.map_keys("_old"))
    scanned = written(blobs.select("blob", F.map_concat("_old", fresh).alias("found")))
    return scanned.unionByName(ledger.select("blob", "found").join(scanned.select("blob"), "blob", "left_anti"))


def scan_in_turn(versions: DataFrame, turn: Column, turns: int = 2, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger after turns updates, each with the versions whose turn (0, 1, ...) has come, the ledger written in between."""
    ledger = None
    for k in range(turns):
        ledger = update(versions.where(turn == k), ledger, rules, text)
        ledger = written(ledger) if k else ledger
    return ledger


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """versions with ``found`` (map from rule name to spans) for every row, null where nothing was found.

    A column of versions named found gives way to it; all other names are free.
    """
    names = [f"_c{i}" for i in range(len(versions.columns))]  # clash with no column of the join
    at = F.col(names[versions.columns.index(text)])
    keys = [r.key for r in rules]
    hits = ledger.select("blob", F.map_filter("found", lambda k, v: k.isin(keys) & (F.size(v) > 0)).alias("found")).where(F.size("found") > 0)
    hits = hits.select(F.col("blob").alias("_blob"), F.transform_keys("found", lambda k, _: F.substring_index(k, "@", 1)).alias("found"))
    hits = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = versions.toDF(*names).withColumn("_blob", blob_id(at)).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = rows.join(hits, ["_blob", "_salt"], "left")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, versions.columns, strict=True) if c != "found"], "found")


def span_list(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of rules, by start, then the rules' order, comma-joined."""
    def tagged(place: int, name: str) -> Column:
        spans = F.coalesce(F.try_element_at(found, F.lit(name)), F.array().cast(SPANS))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("rule"), s["end"].alias("end")))

    each = [tagged(place, r.name) for place, r in enumerate(rules)]
    names = F.array(*[F.lit(r.name) for r in rules])
    ordered = F.array_sort(F.concat(*each))
    return F.coalesce(F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"], s["end"])), ","), F.lit(""))


def digest(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans and the list of all spans, one row per row of docs.

    Only the address of a text takes part in the join, not the text.
    """
    rows = docs.select("doc_id", blob_id(F.col("text")).alias("_blob"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"))
    keys = [r.key for r in rules]
    hits = ledger.select(F.col("blob").alias("_blob"), F.map_filter("found", lambda k, v: k.isin(keys) & (F.size(v) > 0)).alias("found")).where(F.size("found") > 0)
    hits = hits.withColumn("found", F.transform_keys("found", lambda k, _: F.substring_index(k, "@", 1)))
    count = lambda name: F.coalesce(F.size(F.try_element_at("found", F.lit(name))), F.lit(0))
    hits = hits.select("_blob", *[count(r.name).cast("long").alias(f"n_{r.name}") for r in BASE], F.sha2(span_list(F.col("found"), BASE), 256).alias("base_sha256"), span_list(F.col("found"), rules).alias("spans"))
    hits = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.join(hits, ["_blob", "_salt"], "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """versions with every span that the ledger has for a text replaced by mark; spans that overlap become one. All rows and columns stay.

    The text is cut at the spans' bytes, so a piece costs its own length.
    """
    names = [f"_c{i}" for i in range(len(versions.columns))]
    at = names[versions.columns.index("text")]
    found = findings(versions.toDF(*names), ledger, rules, text=at)
    whole = F.struct(F.col(at).cast("binary").alias("raw"), F.array_sort(F.transform(F.flatten(F.map_values("found")), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to")))).alias("spans"))

    def cut(x: Column) -> Column:
        raw, spans = x["raw"], x["spans"]
        ends = running(F.transform(spans, lambda s: s["to"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def pieces(end: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(end, i - 1)).otherwise(F.lit(0))
            part = lambda s, i: F.when(s["from"] >= before(i), F.concat(F.substring(raw, before(i) + 1, s["from"] - before(i)).cast("string"), F.lit(mark))).otherwise(F.lit(""))
            rest = F.substring(raw, F.element_at(end, -1) + 1, F.octet_length(raw)).cast("string")
            return F.concat(F.array_join(F.transform(spans, part), ""), rest)

        return let(ends, pieces)

    cleaned = F.when(F.col("found").isNull(), F.col(at)).otherwise(let(whole, cut))
    return found.withColumn(at, cleaned).select(*[F.col(n).alias(c) for n, c in zip(names, versions.columns, strict=True)])
