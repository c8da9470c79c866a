"""Quality rules from cross-document line frequency.

A line is normalised (lower case, white space runs to one space, trimmed) and
hashed to 64 bits. Per host, the distinct documents of each line are counted;
a line is boilerplate on a host where it stands in at least ``min_docs``
documents and in more than ``max_share`` of the host's documents. Boilerplate
lines are removed. A document that fails the base rules, or keeps less than
``least_left`` of its words, is rejected.

Base rules count over the whole text; repeated five-word windows are first
looked for by hash, and counted by their words only in the few documents that
have two windows of one hash.

Everything runs in built-in functions. Texts are read once: base counts and
the hashes and word counts of a row's lines are written to the shared folder,
keyed by row. The first grouping holds the document, so a line that stands in
a third of all documents is still dealt over all tasks, and the second gets
one row per line and map task. Joins with hosts and with boilerplate lines are
salted.

Edge cases: a null text has no words and fails; a document without a wordy
line has none to remove. Rows that share an id count as one document for the
line counts of their hosts, whether their texts are equal or not; a row
without an id is a document of its own. Each row (repeated ones and ties too)
is returned with the counts of its own text. A null host is a host of its own;
an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, word_array, written
from lodestone.llm.spans import let

WINDOW = 5
SALTS = 32


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more, all its places included."""
    last = F.size(words) - WINDOW
    places = F.sequence(F.lit(0), last)
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(ws: Column) -> Column:
        spelled = F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.struct(F.array_join(F.slice(ws, i + 1, F.lit(WINDOW)), " ").alias("g"), i.alias("i")))

        def again(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["g"] == F.get(s, b)["g"]
            twice = F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((j > 0) & same(j, j - 1) | F.coalesce(same(j, j + 1), F.lit(False))).alias("twice"))), lambda x: x["twice"])
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"), (i + WINDOW).alias("end"))
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

        return let(F.array_sort(spelled), again)

    return F.when(last < 1, F.lit(0)).otherwise(let(hashed, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(words))))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_counts(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", ""))

    def counts(words: Column) -> Column:
        parts = {"n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")), "n_symbols": symbols, "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(words)}
        return F.struct(*[c.cast("long").alias(n) for n, c in parts.items()])

    return let(word_array(text), counts)


def normalise(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), SPACE, " "), F.lit(" "))


def line_list(text: Column) -> Column:
    """array<struct<h, n>>: hash and number of words of each wordy line."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), normalise), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def _host(source: Column) -> Column:
    """A host as a join key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def boilerplate(rows: DataFrame, lines: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """host, h of the lines above the limits. rows: row, doc_id, host; lines: these and h."""
    own = F.when(F.col("doc_id").isNull(), F.col("row")).alias("own")
    salted = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counts = lines.select("host", "h", "doc_id", own).distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    hosts = rows.select("host", "doc_id", own).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    found = counts.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted(hosts), ["host", "salt"])
    return found.where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "h")


def removals(rows: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """row, h, n of the boilerplate lines of rows (row, doc_id, host, lines)."""
    lines = rows.select("row", "doc_id", "host", F.explode("lines").alias("l")).select("row", "doc_id", "host", "l.h", "l.n")
    bad = boilerplate(rows, lines, min_docs, max_share).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = lines.select("row", "host", "h", "n", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    return own.join(bad, ["host", "h", "salt"], "left_semi").select("row", "h", "n")


def line_quality(docs: DataFrame, min_docs: int = 10, max_share: float = 0.02, least_left: float = 0.5) -> DataFrame:
    """doc_id, the base counts, n_removed, base_failed and kept, one row per row of docs."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _host(F.col("source")).alias("host"), base_counts(F.col("text")).alias("b"), F.coalesce(line_list(F.col("text")), F.array()).alias("lines")))
    removed = removals(rows, min_docs, max_share).groupBy("row").agg(F.sum("n").cast("long").alias("n_removed"))
    out = rows.select("row", "doc_id", "b.*").join(removed, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long"))).drop("row")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed") < least_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_boilerplate(docs: DataFrame, min_docs: int = 10, max_share: float = 0.02) -> DataFrame:
    """docs with its boilerplate lines cut out of text; lines that stay are as they were. All columns stay."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # clash with no column of the joins
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    whole = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    rows = whole.select("row", at["doc_id"].alias("doc_id"), _host(at["source"]).alias("host"), F.coalesce(line_list(at["text"]), F.array()).alias("lines"))
    cut = removals(rows, min_docs, max_share).groupBy("row").agg(F.collect_set("h").alias("cut"))
    left = F.array_join(F.filter(F.split(at["text"], "\n", -1), lambda x: ~F.array_contains("cut", F.xxhash64(normalise(x))) | (normalise(x) == "")), "\n")
    text = F.when(F.col("cut").isNull(), at["text"]).otherwise(left)
    return whole.join(cut, "row", "left").select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])
