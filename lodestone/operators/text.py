"""Lines, offsets, words and matches of file contents. Columns and offsets count bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions.regex import java_pattern, longest_pattern
from lodestone.operators.sweep import top_runs
from lodestone.sources.store import materialise

#: Bytes of text that a batch holds at a time.
PART = 1 << 20
_WORD_BYTE = np.array([chr(c).isalnum() and c < 128 or c == 95 for c in range(256)])
#: Bytes of a file to a stretch that offsets are looked up in.
STRETCH = 4096


def line_array(content: Column) -> Column:
    """Lines; what follows a last line feed is no line, and an empty file has none."""
    parts = F.split(content, "\n", -1)
    return F.when(content == "", F.array().cast("array<string>")).when(F.endswith(content, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 0), start, len, text of every line.

    Files are cut and their starts summed in Arrow batches; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, "content"):
                cut = [x.removesuffix(b"\n").split(b"\n") if x else [] for x in part.column("content").to_pylist()]
                of = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
                n = np.array([len(t) for x in cut for t in x], np.int64)
                begins = np.cumsum(n + 1) - n - 1
                firsts = np.flatnonzero(np.diff(of, prepend=-1))
                count = np.diff(np.append(firsts, len(of)))
                line = np.arange(len(of)) - np.repeat(firsts, count)
                text = pa.array([t for x in cut for t in x], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("file").take(pa.array(of)), pa.array(line, pa.int64()), pa.array(begins - np.repeat(begins[firsts], count), pa.int64()), pa.array(n), text], ["file", "line", "start", "len", "text"])

    result = f"file {files.schema['file'].dataType.simpleString()}, line bigint, start bigint, len bigint, text string"
    return files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(run, result)


def _parts(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about PART bytes of a binary column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PART, prepend=-1)) if len(sizes) else []
    for x, y in pairwise([*edges, b.num_rows]):
        yield b.slice(int(x), int(y - x))


def offset_to_line(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """file, offset, line, col: the last line that starts at or before each offset (of file, offset).

    Line starts and offsets are put in order within each stretch of a file; the
    last start of earlier stretches is one row per stretch. No line is paired
    with an offset, and a large file is dealt over its stretches.
    """
    starts = lines(files).select("file", F.col("start").alias("at"), "line", F.lit(False).alias("wanted"))
    wanted = offsets.select("file", F.col("offset").cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("line"), F.lit(True).alias("wanted")).distinct()
    both = materialise(starts.unionByName(wanted).withColumn("b", F.floor(F.col("at") / STRETCH)))
    start = F.when(~F.col("wanted"), F.struct("at", "line"))
    heads = both.groupBy("file", "b").agg(F.max(start).alias("head"))
    before = F.last("head", ignorenulls=True).over(W.partitionBy("file").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    here = F.last(start, ignorenulls=True).over(W.partitionBy("file", "b").orderBy("at", "wanted").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = both.withColumn("s", here).join(heads.select("file", "b", before.alias("before")), ["file", "b"]).where("wanted").withColumn("s", F.coalesce("s", "before"))
    return placed.where("s IS NOT NULL").select("file", F.col("at").alias("offset"), "s.line", (F.col("at") - F.col("s.at")).alias("col"))


def location_to_offset(line_rows: DataFrame, places: DataFrame) -> DataFrame:
    """file, line, col to offset; columns beyond the line stand at its end."""
    return places.join(line_rows, ["file", "line"]).select("file", "line", "col", (F.col("start") + F.least("col", "len")).alias("offset"))


def tab_width(line: Column, stop: int = 8) -> Column:
    """Width with tabs reaching to the next stop; other characters count their bytes."""
    cells = F.split(line, "\t", -1)
    def add(acc: Column, cell: Column) -> Column:
        tabbed = F.when(acc["first"], 0).otherwise((F.floor(acc["w"] / stop) + 1) * stop)
        return F.struct((tabbed + F.octet_length(cell)).cast("bigint").alias("w"), F.lit(False).alias("first"))
    return F.aggregate(cells, F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(True).alias("first")), add, lambda acc: acc["w"])


def longest_line(files: DataFrame, stop: int = 8) -> DataFrame:
    """file, width of its widest line; 0 without lines."""
    width = F.array_max(F.transform(line_array(F.col("content")), lambda x: tab_width(x, stop)))
    return files.select("file", F.coalesce(width, F.lit(0)).cast("bigint").alias("width"))


def words_at(line_rows: DataFrame, places: DataFrame) -> DataFrame:
    """file, line, col, word: the run of word characters around each place, or the one character there (the whole one, at any of its bytes)."""
    hit = places.distinct().join(line_rows, ["file", "line"]).where((F.col("col") >= 0) & (F.col("col") < F.col("len")))
    at = F.col("col").cast("int")
    raw = F.col("text").cast("binary")
    tail = lambda x: F.regexp_extract(x.cast("string"), "[A-Za-z0-9_]*$", 0)
    head = lambda x: F.regexp_extract(x.cast("string"), "^[A-Za-z0-9_]*", 0)
    before, after = tail(F.substring(raw, F.lit(1), at)), head(F.substring(raw, at + 1, F.col("len").cast("int")))
    one = F.substring(F.col("text"), F.length(F.substring(raw, F.lit(1), at + 1).cast("string")), F.lit(1))  # a character cut off at its end counts
    return hit.select("file", "line", "col", F.when(after != "", F.concat(before, after)).otherwise(one).alias("word"))


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """file, idx (from 0), start, len, of all matches of a pattern, in bytes: leftmost-longest, non-overlapping.

    Empty matches count, but for those at the end of the match before. An empty
    pattern has none. Java leaves out the files without a match; the search in
    the others is sequential per file and runs in Arrow batches.
    """
    result = "file string, idx bigint, start bigint, len bigint"
    if not pattern:
        return files.sparkSession.createDataFrame([], result)
    longest_pattern(pattern)  # an invalid one fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = longest_pattern(pattern)
        for b in (part for whole in batches for part in _parts(whole, "content")):
            out: list[tuple] = []
            for file, text in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                spans = [m.span() for m in compiled.finditer(text)]
                spans = [x for x, before in zip(spans, [(-1, -1), *spans], strict=False) if x[1] > before[1]]  # without empty ones at the end of the one before
                marks = [0, *(place for x in spans for place in x)]
                places = list(accumulate(len(text[x:y].encode()) for x, y in pairwise(marks)))
                out += [(file, i, places[2 * i], places[2 * i + 1] - places[2 * i]) for i in range(len(spans))]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "idx", "start", "len"])

    return files.where(F.col("content").rlike(java_pattern(pattern))).select("file", "content").mapInArrow(run, result)


def next_previous(found: DataFrame) -> DataFrame:
    """Matches with the starts of the next and the previous match of their file, going round at the ends."""
    w = W.partitionBy("file").orderBy("idx")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return found.select(
        "file", "idx", "start",
        F.coalesce(F.lead("start").over(w), F.first("start").over(whole)).alias("next_start"),
        F.coalesce(F.lag("start").over(w), F.last("start").over(whole)).alias("previous_start"),
    )


def best_match(found: DataFrame, states: DataFrame) -> DataFrame:
    """file, find_start, previous, best: which match to select. find_start and previous are offsets, -1 where there is none.

    The last match at or before previous (else the last of all) if it lies from
    find_start to previous, going round; else the first at or after previous,
    going round; without a previous match the first at or after find_start, else
    the first.
    """
    s, prev, idx, at = F.col("find_start"), F.col("previous"), F.col("idx"), F.col("start")
    per = states.distinct().join(found, "file").groupBy("file", "find_start", "previous").agg(
        F.max(F.when(at <= prev, F.struct(idx, at))).alias("before"), F.max(F.struct(idx, at)).alias("last"),
        F.min(F.when(at >= prev, idx)).alias("after"), F.min(F.when(at >= s, idx)).alias("from_start"),
    )
    c = F.coalesce("before", "last")
    inside = F.when(s <= prev, (c["start"] >= s) & (c["start"] <= prev)).otherwise((c["start"] >= s) | (c["start"] <= prev))
    kept = F.when(inside, c["idx"]).otherwise(F.coalesce("after", F.lit(0)))
    fresh = F.when(s != -1, F.coalesce("from_start", F.lit(0))).otherwise(F.lit(0))
    return per.select("file", "find_start", "previous", F.when(prev != -1, kept).otherwise(fresh).cast("bigint").alias("best"))


def match_label(pattern: Column, count: Column, selected: Column) -> Column:
    """Text beside the find bar; selected is 0-based, null or -1 where none is. Nothing for an empty pattern."""
    return (
        F.when(pattern == "", F.lit("")).when(selected >= 0, F.concat((selected + 1).cast("string"), F.lit(" of "), count.cast("string")))
        .when(count == 1, F.lit("1 match")).otherwise(F.concat(count.cast("string"), F.lit(" matches")))
    )


def range_text(content: Column, start: Column, end: Column) -> Column:
    """Text of the byte range from start to end, cut to the content."""
    first = F.greatest(start, F.lit(0)).cast("int")
    last = F.least(end, F.octet_length(content)).cast("int")
    return F.substring(content.cast("binary"), first + 1, F.greatest(last - first, F.lit(0))).cast("string")


def char_widths(line_rows: DataFrame) -> DataFrame:
    """file, line, col (byte), n (bytes), is_word of every character."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, "text"):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
                lead = (data & 0xC0) != 0x80
                lead[edges[:-1][edges[:-1] < edges[1:]]] = True
                at = np.flatnonzero(lead)
                n = np.diff(np.append(at, len(data)))
                first = np.searchsorted(at, edges)
                col = at - np.repeat(edges[:-1], np.diff(first))
                offsets = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (col, n, _WORD_BYTE[data[at]])]
                yield pa.RecordBatch.from_arrays([part.column("file"), part.column("line"), *lists], ["file", "line", "col", "n", "is_word"])

    kinds = ", ".join(f"{c} {line_rows.schema[c].dataType.simpleString()}" for c in ("file", "line"))
    own = line_rows.select("file", "line", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{kinds}, col array<bigint>, n array<bigint>, is_word array<boolean>")
    return own.select("file", "line", F.explode(F.arrays_zip("col", "n", "is_word")).alias("x")).select("file", "line", "x.*")


def backgrounds(spans: DataFrame) -> DataFrame:
    """file, start, end, what: runs of the strongest of the spans (file, start, end, what) over each byte: selection, then hover, then match."""
    rank = F.when(F.col("what") == "selection", 3).when(F.col("what") == "hover", 2).otherwise(1)
    return top_runs(spans.select("file", "start", "end", rank.cast("bigint").alias("rank"), F.col("what").alias("value")), ["file"]).withColumnRenamed("value", "what")


def canonical_files(files: DataFrame, salts: int = 16) -> DataFrame:
    """real_path, id, canonical: the context (the smallest id) of each file (id, real_path); one per real path, however many names reach it."""
    first = files.groupBy("real_path").agg(F.min("id").alias("canonical")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return files.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(first, ["real_path", "_salt"]).select("real_path", "id", "canonical")
