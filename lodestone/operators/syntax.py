"""Lexical kinds of source text, and symbol colours over them.

What a byte is depends on all text before it. A file is cut into pieces at
places where no token but a comment, a quotation or an included name can be open
and no escape pending, so seven states say all that a piece must know. Where a
file has several pieces, each is read from all seven states for the state that it
ends in; these mappings are composed along the file by pointers, and then every
piece is read once from the state it really begins in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.operators.dictionary import ranked
from lodestone.operators.pointers import followed
from lodestone.operators.sweep import top_runs
from lodestone.sources.store import materialise

# Words of the language.
DIRECTIVES = frozenset("if ifdef ifndef elif else endif include define undef line error pragma warning include_next import".split())
KEYWORDS = frozenset(
    """alignas alignof asm auto bool break case catch char char16_t char32_t class const constexpr const_cast continue decltype default
    delete double do dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new
    noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert
    static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void
    volatile wchar_t while and not_eq and_eq or bitand or_eq bitor xor compl xor_eq not""".split()
)
# Colours of kinds of text.
KIND_COLOURS = {"comment": "darkGreen", "quoted": "darkGreen", "number": "darkBlue", "directive": "darkBlue", "keyword": "darkYellow"}
# Colour of the symbols of a type; other types leave the text's own colour.
SYMBOL_COLOURS = {"GlobalVariable": "darkCyan", "Field": "darkRed", "Namespace": "darkMagenta", "Struct": "darkMagenta", "Class": "darkMagenta", "Union": "darkMagenta", "Enum": "darkMagenta", "Typedef": "darkMagenta", "Macro": "darkBlue"}
_TOKEN = re.compile(
    rb"""(?P<comment>/\*(?:.*?\*/|.*\Z)|//(?:[^\n]|(?<=\\)\n)*\n?)
    |(?P<quoted>'(?:\\.|[^\\'])*(?:'|\\?\Z)|"(?:\\.|[^\\"])*(?:"|\\?\Z))
    |(?P<number>\.?[0-9](?:[eE][+-]|[A-Za-z0-9_.])*)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<directive>\#[ \t]*[A-Za-z_]*)
    |(?P<angled>[ \t]*<(?:\\.|[^\\>])*(?:>|\\?\Z))
    |(?P<line>\n)
    |(?P<other>[^\n])""",
    re.S | re.X,
)


def _words(words: frozenset) -> bytes:
    """A pattern of the words, by first letter."""
    first: dict[str, list[str]] = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in first.items()).encode()


#: Text of the default kind that may hold line feeds, taken at once: words but keywords, and marks that begin no token where no included name is awaited.
_PLAIN = re.compile(rb"(?:[^A-Za-z_0-9.#'\"/]|(?!(?:" + _words(KEYWORDS) + rb")(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*|\.(?![0-9])|/(?![/*]))+")

#: States at the beginning of a piece: at the start of a line, within one, in a block comment, a line comment, quotations, an included name.
FRESH, WITHIN, BLOCK_COMMENT, LINE_COMMENT, SINGLE, DOUBLE, ANGLED = range(7)
STATES = 7
_REST = {
    BLOCK_COMMENT: re.compile(rb".*?\*/|.*", re.S), LINE_COMMENT: re.compile(rb"(?:[^\n]|(?<=\\)\n)*\n?", re.S), SINGLE: re.compile(rb"(?:\\.|[^\\'])*(?:'|\\?\Z)", re.S),
    DOUBLE: re.compile(rb'(?:\\.|[^\\"])*(?:"|\\?\Z)', re.S), ANGLED: re.compile(rb"(?:\\.|[^\\>])*(?:>|\\?\Z)", re.S),
}
_SAFE = re.compile(rb"[\n;,{}()]")
#: Bytes to a piece.
PIECE = 1 << 18


def cuts(data: bytes, size: int = PIECE) -> list[int]:
    """Where the pieces of a text end: after the next line feed, or a mark that no token goes across where a line is long."""
    ends = []
    at = 0
    while len(data) - at > size:
        line = data.find(b"\n", at + size - 1, at + 2 * size)
        mark = _SAFE.search(data, at + size - 1) if line < 0 else None
        at = line + 1 if line >= 0 else mark.end() if mark else len(data)
        ends.append(at)
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    return ends


def read_piece(content: bytes, state: int = FRESH) -> tuple[list[tuple[int, int, str]], int]:
    """Runs (start, end, kind) of a piece that begins in a state, neighbours of different kinds, and the state that it ends in.

    A directive counts only where nothing but blanks stands before it on its
    line, after a line comment or at the start; a quotation ends at its mark or
    with the text, not with the line. The state is right for pieces that end as
    cuts() ends them.
    """
    runs: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if end <= start:
            return
        if runs and runs[-1][2] == kind:
            runs[-1] = (runs[-1][0], end, kind)
        else:
            runs.append((start, end, kind))

    at, fresh, include, left = 0, state == FRESH, False, None
    if state in _REST:
        at = _REST[state].match(content).end()
        add(0, at, "comment" if state in (BLOCK_COMMENT, LINE_COMMENT) else "quoted")
        fresh, left = state == LINE_COMMENT, state
    while at < len(content):
        if not include and (m := _PLAIN.match(content, at)):
            line = content.rfind(b"\n", at, m.end())
            fresh = (line >= 0 or fresh) and not content[max(line + 1, at) : m.end()].strip(b" \t")
            add(at, m.end(), "default")
            at, left = m.end(), None
            continue
        m = _TOKEN.match(content, at)
        what, text = m.lastgroup, m[0]
        if what == "angled" and not include or what == "directive" and not fresh:
            add(at, at + 1, "default")
            what, end = "other", at + 1
            text = content[at:end]
        else:
            end = m.end()
        include, left = False, None
        if what == "directive":
            name = text[1:].strip(b" \t").decode()
            known = name in DIRECTIVES
            add(at, end, "directive" if known else "default")
            include = known and name in ("include", "include_next", "import")
            fresh = False
        elif what == "angled":
            blanks = len(text) - len(text.lstrip(b" \t"))
            add(at, at + blanks, "default")
            add(at + blanks, end, "quoted")
            fresh, left = False, ANGLED
        elif what == "word":
            add(at, end, "keyword" if text.decode() in KEYWORDS else "default")
            fresh = False
        elif what == "comment":
            add(at, end, "comment")
            fresh = text.startswith(b"//")
            left = LINE_COMMENT if fresh else BLOCK_COMMENT
        elif what in ("quoted", "number"):
            add(at, end, what)
            fresh = False
            if what == "quoted":
                left = SINGLE if text.startswith(b"'") else DOUBLE
        else:
            add(at, end, "default")
            fresh = what == "line" or fresh and text in (b" ", b"\t")
        at = end
    if left is not None and not (left == LINE_COMMENT and content.endswith(b"\n") and not content.endswith(b"\\\n")):
        return runs, left  # a piece ends with none of the marks that close a token, so its last one is open
    return runs, FRESH if content.endswith(b"\n") else WITHIN


def kinds(content: bytes) -> list[tuple[int, int, str]]:
    """Runs of comment, quoted, number, keyword, directive and default over a whole text."""
    return read_piece(content)[0]


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over at least as many partitions as shuffles have; scans of few row groups would leave all reading to few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *by)


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    kinds_ = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds_))], ["file", "start", "end", "kind", "edge"])


def pieces(files: DataFrame, size: int = PIECE) -> DataFrame:
    """row, file, n, of, offset, data: the pieces of every file (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, file, data in zip(*(b.column(c) for c in ("row", "file", "data")), strict=True):
                whole = data.as_py() or b""
                ends = cuts(whole, size)
                starts = [0, *ends[:-1]]
                k = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * k, pa.int64()), pa.array([file.as_py()] * k, pa.string()), pa.array(range(k), pa.int64()), pa.array([k] * k, pa.int64()), pa.array(starts, pa.int64()), pa.array([whole[x:y] for x, y in zip(starts, ends, strict=True)], pa.binary())],
                    ["row", "file", "n", "of", "offset", "data"],
                )

    rows = files.select(F.monotonically_increasing_id().alias("row"), "file", F.col("content").cast("binary").alias("data"))
    return rows.mapInArrow(run, "row long, file string, n long, of long, offset long, data binary")


def _packed(ends: list[int]) -> int:
    return sum(e << 3 * s for s, e in enumerate(ends))


def _ends_in(vector: Column, state: Column) -> Column:
    return F.call_function("shiftright", vector, (state * 3).cast("int")).bitwiseAND(7)


def _composed(near: Column, far: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for s in range(STATES):
        out = out.bitwiseOR(F.call_function("shiftleft", _ends_in(near, _ends_in(far, F.lit(s))), F.lit(3 * s)))
    return F.when(far.isNull(), near).otherwise(out)


def begin_states(parts: DataFrame) -> DataFrame:
    """row, n, state: the state in which each piece (row, n, data) begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [_packed([read_piece(d.as_py(), s)[1] for s in (range(STATES) if n.as_py() else [FRESH] * STATES)]) for n, d in zip(b.column("n"), b.column("data"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(vectors, pa.int64())], ["row", "n", "vector"])

    c = F.col
    found = parts.select("row", "n", "data").mapInArrow(run, "row long, n long, vector long")
    alike = F.lit(True)
    for s in range(1, STATES):
        alike = alike & (_ends_in(c("vector"), F.lit(s)) == _ends_in(c("vector"), F.lit(0)))
    linked = found.select(F.struct("row", "n").alias("at"), F.when(~alike, F.struct("row", (c("n") - 1).alias("n"))).alias("up"), "vector")
    ends = followed(linked, "at", "up", {"vector": _composed})
    return ends.select(c("at.row").alias("row"), (c("at.n") + 1).alias("n"), _ends_in(c("vector"), F.lit(FRESH)).cast("int").alias("state"))


def _read(parts: DataFrame) -> DataFrame:
    """file, start, end, kind, edge (the run touches an end of a piece that is none of the file) of pieces with their states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, n, of, offset, data, state in zip(*(b.column(c) for c in ("file", "n", "of", "offset", "data", "state")), strict=True):
                got, at = read_piece(data.as_py(), state.as_py())[0], offset.as_py()
                first, last = n.as_py() > 0, n.as_py() < of.as_py() - 1
                rows += [(file.as_py(), at + x, at + y, kind, first and i == 0 or last and i == len(got) - 1) for i, (x, y, kind) in enumerate(got)]
            yield _runs(rows)

    return parts.select("file", "n", "of", "offset", "data", "state").mapInArrow(run, "file string, start bigint, end bigint, kind string, edge boolean")


def syntax_kinds(files: DataFrame, size: int = PIECE) -> DataFrame:
    """file, start, end, kind: the runs of every file (file, content), in bytes. A null or empty content has none.

    Files of up to size bytes are read by themselves. Larger ones are written in
    pieces (an action, and a few more for their states), which are dealt over
    all tasks; only the runs at the pieces' ends meet again, to be put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file"), b.column("content"), strict=True):
                yield _runs([(file.as_py(), *r, False) for r in kinds((content.as_py() or "").encode())])

    bytes_ = F.coalesce(F.octet_length("content"), F.lit(0))
    result = ["file", "start", "end", "kind"]
    small = _dealt(files.where(bytes_ <= size).select("file", "content"), "file").mapInArrow(run, "file string, start bigint, end bigint, kind string, edge boolean")
    parts = materialise(pieces(files.where(bytes_ > size), size))
    if not parts.limit(1).count():
        return small.select(*result)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "row", "n")
    states = materialise(begin_states(dealt))
    runs = materialise(_read(dealt.join(states, ["row", "n"], "left").withColumn("state", F.coalesce("state", F.lit(FRESH)))))
    by = W.partitionBy("file").orderBy("start", "end")  # two runs of a piece at most
    edges = runs.where("edge").withColumn("new", F.coalesce((F.lag("kind").over(by) != F.col("kind")) | (F.lag("end").over(by) != F.col("start")), F.lit(True)).cast("int"))
    joined = edges.withColumn("island", F.sum("new").over(by)).groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind"))
    return small.select(*result).unionByName(runs.where("NOT edge").select(*result)).unionByName(joined.select(*result))


def colour(symbol_type: Column) -> Column:
    """Colour of a symbol type, null for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SYMBOL_COLOURS.items() for x in kv]), symbol_type)


def colour_overlay(facts: DataFrame) -> DataFrame:
    """file, line, start, end, colour: runs of the colour of the last coloured reference over each column."""
    types = facts.groupBy("symbol").agg(F.max("symbol_type").alias("symbol_type"))
    spans = facts.select("file", "line", "start_col", "end_col", "symbol", "kind").distinct().join(types, "symbol").withColumn("value", colour(F.col("symbol_type"))).where("value IS NOT NULL AND end_col > start_col")
    order = ranked(spans, ["start_col", "end_col", "symbol", "kind", "value"], "rank")
    runs = top_runs(order.select("file", "line", F.col("start_col").alias("start"), F.col("end_col").alias("end"), "rank", "value"), ["file", "line"])
    return runs.withColumnRenamed("value", "colour")


def file_colours(files: DataFrame, spans: DataFrame, size: int = PIECE) -> DataFrame:
    """file, start, end, colour: runs of one colour (bytes) over every file.

    spans (file, start, end, colour, and seq: their order, of which a later one
    and then the greater colour counts): a byte has the colour of the last span
    over it, else that of its kind of text, else default.
    """
    colours = F.create_map(*[F.lit(x) for kv in KIND_COLOURS.items() for x in kv])
    ground = syntax_kinds(files, size).select("file", "start", "end", F.lit(-(1 << 63)).alias("rank"), F.coalesce(F.try_element_at(colours, "kind"), F.lit("default")).alias("value"))
    ends = files.select("file", F.octet_length("content").cast("bigint").alias("bytes"))
    over = spans.join(ends, "file").select("file", F.greatest("start", F.lit(0)).cast("bigint").alias("start"), F.least("end", "bytes").alias("end"), F.col("seq").cast("bigint").alias("rank"), F.col("colour").alias("value"))
    return top_runs(ground.unionByName(over), ["file"]).withColumnRenamed("value", "colour")
