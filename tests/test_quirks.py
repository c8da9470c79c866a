"""Hand-computed cases of the semantics that are easy to get wrong."""

from __future__ import annotations

import hashlib
import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import regex
from lodestone.operators import classify, dictionary, history, merge, report, syntax, tables, text, trace, tree, xref
from lodestone.schema import FACTS
from lodestone.sources.store import clean_text, layout, text_files


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tables_are_sets(spark):
    f = facts(spark, [("@/a", 1, 1, 2, "s", "Read", None)] * 2)
    assert tables.distinct_rows(f).count() == 1


def test_prefix_bound(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 0)], "a int, b int")
    assert [tuple(r) for r in tables.lower_bound(df, ["a", "b"], [1]).collect()] == [(1, 1)]
    assert [tuple(r) for r in tables.lower_bound(df, ["a", "b"], [1, 2]).collect()] == [(1, 2)]
    assert tables.lower_bound(df, ["a", "b"], [3]).count() == 0


def test_line_range_is_inclusive(spark):
    f = facts(spark, [("@/a", i, 1, 2, "s", "Read", None) for i in range(1, 6)])
    assert sorted(r.line for r in xref.file_refs(f, "@/a", 2, 4).collect()) == [2, 3, 4]
    assert xref.file_refs(f, "@/b").count() == 0


def test_single_definition(spark):
    f = facts(spark, [
        ("@/a", 1, 1, 2, "two", "Definition", None), ("@/b", 1, 1, 2, "two", "Definition", None), ("@/c", 1, 1, 2, "two", "Declaration", None),
        ("@/a", 2, 1, 2, "decl", "Declaration", None), ("@/a", 3, 1, 2, "both", "Definition", None), ("@/a", 4, 1, 2, "both", "Declaration", None), ("@/a", 5, 1, 2, "none", "Read", None),
    ])
    assert rows(xref.single_definition(f).where("line IS NOT NULL"), "symbol", "line") == [("both", 3), ("decl", 2)]
    wanted = spark.createDataFrame([("@/a",), ("@/zz",), ("two",), ("both",)], "symbol string")
    got = {tuple(r) for r in xref.definitions_of(f, wanted).collect()}
    assert got == {("@/a", "@/a", 1, 1, 1, None), ("both", "@/a", 3, 1, 2, "Definition")}


def test_nested_spans(spark):
    f = facts(spark, [("@/a", 1, 1, 10, "outer", "Read", None), ("@/a", 1, 3, 8, "wide", "Read", None), ("@/a", 1, 3, 5, "inner", "Read", None)])
    points = spark.createDataFrame([("@/a", 1, 4), ("@/a", 1, 5), ("@/a", 1, 10)], "file string, line bigint, col bigint")
    assert rows(xref.point_in_span(f, points), "col", "symbol") == [(4, "inner"), (5, "wide")]


def test_descending_reverses_ties(spark):
    r = report.Report("t", ("x",), spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), (None, 3)], "x string, source_row int"))
    up = [x.source_row for x in r.sorted("x").orderBy("position").collect()]
    down = [x.source_row for x in r.sorted("x", descending=True).orderBy("position").collect()]
    assert up == [3, 0, 1, 2] and down == up[::-1]


def test_smart_case(spark):
    df = spark.createDataFrame([("FOO foo",), ("É",)], "x string")
    hits = lambda p: df.where(regex.report_filter(F.col("x"), p)).count()
    assert hits("foo") == 1 and hits("fOO") == 0 and hits("é") == 1 and hits("") == 2 and hits("\\Boo") == 1 and hits("\\BOo") == 0
    assert regex.next_filter(spark, "(", "old") == "old" and regex.next_filter(spark, "(a)", "old") == "(a)"


def test_lines(spark):
    cases = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb": ["a", "b"], "a\rb": ["a", "b"], "é x\n\ny": ["é x", "", "y"], "cut\0off": ["cut"]}
    df = spark.createDataFrame(list(enumerate(cases)), "file int, content string").withColumn("content", clean_text(F.col("content")))
    got = text.lines(df).collect()
    for i, want in enumerate(cases.values()):
        own = sorted((r.line, r.start, r.text) for r in got if r.file == i)
        assert [t for _, _, t in own] == want
        assert [s for _, s, _ in own] == [0, *itertools.accumulate(len(t.encode()) + 1 for t in want)][: len(want)]


def test_offsets_and_words(spark):
    df = spark.createDataFrame([("f", "é x\nab_1 c")], "file string, content string")
    at = spark.createDataFrame([("f", 0), ("f", 4), ("f", 5), ("f", 9)], "file string, offset bigint")
    assert rows(text.offset_to_line(df, at), "offset", "line", "col") == [(0, 0, 0), (4, 0, 4), (5, 1, 0), (9, 1, 4)]
    places = spark.createDataFrame([("f", 0, 3), ("f", 1, 2), ("f", 1, 4)], "file string, line bigint, col bigint")
    assert rows(text.words_at(text.lines(df), places), "line", "col", "word") == [(0, 3, "x"), (1, 2, "ab_1"), (1, 4, " ")]


def test_tab_width(spark):
    want = {"\t": 8, "a\tb": 9, "12345678\t": 16, "": 0, "é": 2}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.tab_width(F.col("x"))).collect()} == want


def test_longest_matches(spark):
    df = spark.createDataFrame([("f", "ab or abcd"), ("g", "axxb"), ("h", "é ab\nÉ"), ("i", None)], "file string, content string")
    found = lambda p: rows(text.matches(df, p), "file", "start", "len")
    assert found("ab|abcd") == [("f", 0, 2), ("f", 6, 4), ("h", 3, 2)]
    assert [r for r in found("x*") if r[0] == "g"] == [("g", 0, 0), ("g", 1, 2), ("g", 4, 0)]
    assert found("[[:alpha:]]+d|a") == [("f", 0, 1), ("f", 6, 4), ("g", 0, 1), ("h", 3, 1)]
    assert found("é") == [("h", 0, 2), ("h", 6, 2)] and found("^é$") == [("h", 6, 2)] and found("") == [] and found("(a|ab)(bcd|c)") == [("f", 6, 4)]
    assert found("\\bor\\b") == [("f", 3, 2)] and found(".b$") == [("g", 2, 2), ("h", 3, 2)]


def test_pattern_syntax(spark):
    good = {"a{2}": "aa", "[]a-]+": "]-a", "[^[:space:]b]": "x", "a|": "", "x{": "x{", "[[:^alpha:]]": "1", "[\\d_]": "_", "\\.": ".", "a**": "aaa", "[^\\W]": "w", "#": "#", "a&&b": "a&&b"}
    for pattern, hit in good.items():
        assert regex.valid(spark, pattern) and regex.longest_pattern(pattern).fullmatch(hit), pattern
        assert spark.range(1).select(F.lit(hit).rlike(f"^(?:{regex.java_pattern(pattern)})$")).first()[0], pattern
    for pattern in ("(", "a)", "[a", "*a", "(?i)a", "(a)\\1", "[[:nope:]]", "a\\", "\\q", "(?=a)"):
        assert not regex.valid(spark, pattern), pattern
    assert not regex.longest_pattern("[^[:alpha:][:^digit:]]").fullmatch("a") and regex.longest_pattern("[^[:alpha:][:^digit:]]").fullmatch("1")


def plain_kinds(source):
    """Kind of every character of an ASCII text, one state machine step at a time."""
    out, state, i, fresh, include = [], "text", 0, True, False
    while i < len(source):
        c, two = source[i], source[i : i + 2]
        was_include, include = include, False
        if two == "/*":
            end = source.find("*/", i + 2)
            end = len(source) if end < 0 else end + 2
            kind, fresh = "comment", False
        elif two == "//":
            end = i
            while end < len(source) and not (source[end] == "\n" and source[end - 1] != "\\"):
                end += 1
            end = min(end + 1, len(source))
            kind, fresh = "comment", True
        elif c in "'\"":
            end = i + 1
            while end < len(source) and source[end] != c:
                end += 2 if source[end] == "\\" else 1
            end = min(end + 1, len(source))
            kind, fresh = "quoted", False
        elif c.isdigit() or c == "." and source[i + 1 : i + 2].isdigit():
            end = i + 1
            while end < len(source) and (source[end].isalnum() or source[end] in "_." or source[end] in "+-" and source[end - 1] in "eE"):
                end += 1
            kind, fresh = "number", False
        elif c.isalpha() or c == "_":
            end = i
            while end < len(source) and (source[end].isalnum() or source[end] == "_"):
                end += 1
            kind, fresh = "keyword" if source[i:end] in syntax.KEYWORDS else "default", False
        elif c == "#" and fresh:
            end = i + 1
            while source[end : end + 1] in (" ", "\t"):
                end += 1
            start = end
            while end < len(source) and (source[end].isalnum() and end > start or source[end].isalpha() or source[end] == "_") and not source[end].isdigit():
                end += 1
            name = source[start:end]
            kind, fresh, include = "directive" if name in syntax.DIRECTIVES else "default", False, name in ("include", "include_next", "import")
        elif was_include and source[i:].lstrip(" \t").startswith("<"):
            at = i + len(source[i:]) - len(source[i:].lstrip(" \t"))
            out += ["default"] * (at - i)
            end = at + 1
            while end < len(source) and source[end] != ">":
                end += 2 if source[end] == "\\" else 1
            i, end = at, min(end + 1, len(source))
            kind, fresh = "quoted", False
        else:
            end, kind = i + 1, "default"
            fresh = c == "\n" or fresh and c in " \t"
        out += [kind] * (end - i)
        i = end
    return out


SOURCES = [
    "int main() { return 0x1F + 1.5e-3; } // done\n#include <a.h>\n#define X 'a'\n", "/* open", "a /* b */ #if x\n  #  if y\n\"s\\\"t\" '\\'' .5 x.5\n", "# include <x>y\n#include \"q\"\n#foo <z>\n// a\\\nb\nint", "while(i<3>2){}", "",
]


@pytest.mark.parametrize("source", SOURCES)
def test_kinds_equal_the_plain_scanner(source):
    got = [k for a, b, k in syntax.kinds(source.encode()) for _ in range(a, b)]
    assert got == plain_kinds(source)


def test_file_colours(spark):
    files = list(enumerate(SOURCES))
    spans = [(0, 4, 8, "darkRed", 1), (0, 6, 10, "darkMagenta", 2), (0, 0, 2, None, 3), (1, 3, 99, "darkBlue", 1)]
    df = spark.createDataFrame([(str(i), s) for i, s in files], "file string, content string")
    got = syntax.file_colours(df, spark.createDataFrame([(str(f), *r) for f, *r in spans], "file string, start bigint, end bigint, colour string, seq bigint")).collect()
    for i, source in files:
        want = [syntax.KIND_COLOURS.get(k, "default") for k in plain_kinds(source)]
        for f, a, b, colour, _ in spans:
            if f == i and colour:
                want[a:b] = [colour] * len(want[a:b])
        runs = sorted((r.start, r.end, r.colour) for r in got if r.file == str(i))
        assert [c for a, b, c in runs for _ in range(a, b)] == want and all(x[2] != y[2] for x, y in itertools.pairwise(runs))


def test_many_lines_and_offsets(spark):
    """The time grows with the lines, and offsets find lines that begin stretches before."""
    content = "x\n" * 100_000 + "y" * 50_000 + "\nz"
    df = spark.createDataFrame([("f", content)], "file string, content string")
    at = spark.createDataFrame([("f", 0), ("f", 199_999), ("f", 240_000), ("f", 250_001)], "file string, offset bigint")
    began = time.time()
    assert rows(text.offset_to_line(df, at), "offset", "line", "col") == [(0, 0, 0), (199_999, 99_999, 1), (240_000, 100_000, 40_000), (250_001, 100_001, 0)]
    assert time.time() - began < 60


def test_archives_hold_an_entry_once(spark, tmp_path):
    a, b = facts(spark, [("@/a", 1, 1, 2, "s", "Read", None)]), facts(spark, [("@/a", 2, 1, 2, "s", "Read", None)])
    with pytest.raises(ValueError, match="@/a"):
        merge.united(a, b)
    assert merge.united(a, b.withColumn("file", F.lit("@/b"))).count() == 2


def test_entry_hashes_over_several_blocks(spark):
    many = facts(spark, [("@/a", i, 1, 2, "s", "Read", None) for i in range(9000)])
    text_of = lambda i: f"@/a|{i}|1|2|s|Read"
    ordered = sorted(map(text_of, range(9000)))
    blocks = [hashlib.sha256("\n".join(ordered[k : k + merge.HASHED]).encode()).hexdigest() for k in range(0, 9000, merge.HASHED)]
    assert merge.entry_hashes(many).first().hash == hashlib.sha256("\n".join(blocks).encode()).hexdigest()


def test_empty_process_lists(spark):
    df = spark.createDataFrame([(1, "/", [], ["gcc"]), (2, "/", [4, 5], ["gcc"])], "line bigint, cwd string, pidlist array<bigint>, argv array<string>")
    assert {r.line: [tuple(p) for p in r.procs] for r in trace.decode_pids(df).collect()} == {1: [], 2: [(4, 5)]}


def test_compile_databases(spark, tmp_path):
    (tmp_path / "t.json").write_text("".join(json.dumps({"cwd": "/b", "pidlist": [1, k], "argv": ["gcc", "-c", f"{k} x.c"]}) + "\n" for k in range(5)))
    steps = trace.compile_steps(trace.read_trace(spark, str(tmp_path / "t.json")), spark.createDataFrame([(f"/b/{k} x.c",) for k in range(4)], "path string"))
    trace.write_compile_db(steps, str(tmp_path / "db"), many=3)
    arrays = [json.loads(p.read_text()) for p in sorted((tmp_path / "db").glob("part-*"))]
    assert [c["file"] for x in arrays for c in x] == [f"{k} x.c" for k in range(4)] and len(arrays) == 2
    assert trace.read_compile_db(spark, str(tmp_path / "db")).count() == 4


def test_match_label(spark):
    f = lambda *a: spark.range(1).select(text.match_label(*map(F.lit, a))).first()[0]
    assert (f("", 0, -1), f("x", 0, -1), f("x", 1, -1), f("x", 5, -1), f("x", 5, 1)) == ("", "0 matches", "1 match", "5 matches", "2 of 5")


def test_span_end(spark):
    f = lambda *a: spark.range(1).select(classify.span_end(*map(F.lit, a))).first()[0]
    assert f(1, 5, 1, 5) == 6 and f(1, 5, 2, 9) == 6 and f(1, 5, 1, 9) == 9 and f(1, 5, 1, 2) == 6


def test_row_width(spark):
    f = lambda v: spark.range(1).select(tables.row_width([F.lit(v)])).first()[0] - 1
    assert [f(v) for v in (0, 126, 127, 16382, 16383)] == [1, 1, 2, 2, 3]


def test_staleness(spark):
    entries = spark.createDataFrame([("a", 5, "x"), ("b", 5, "y"), ("c", 5, "gone"), ("d", 5, "<built-in>"), ("e", None, "x")], "index_file string, index_mtime bigint, name string")
    times = spark.createDataFrame([("x", 5), ("y", 6)], "name string, mtime bigint")
    assert dict(rows(merge.reusable(entries, times), "index_file", "reusable")) == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_reexec_takes_latest(spark):
    records = spark.createDataFrame([
        (1, "/", [5, 1], ["sh"]), (2, "/", [5, 1], ["gcc", "-c", "a.c"]), (3, "/", [5, 1, 1, 1], ["cc1"]), (4, "/", [5, 1], ["ld"]), (5, "/", [5, 1, 2, 2], ["gcc", "-c", "b.c"]),
    ], "line bigint, cwd string, pidlist array<bigint>, argv array<string>")
    assert rows(trace.parents(records), "line", "parent") == [(3, 2), (5, 4)]
    assert rows(trace.below_driver(records), "line") == [(3,)]
    assert rows(trace.compile_steps(records), "line", "file") == [(2, "a.c"), (5, "b.c")]
    known = spark.createDataFrame([("/b.c",)], "path string")
    assert trace.compile_steps(records.withColumn("cwd", F.lit("")), known).count() == 1


def test_quote(spark):
    got = spark.range(1).select(trace.quote(F.array(F.lit("gcc"), F.lit("a b"), F.lit("it's")))).first()[0]
    assert got == "gcc 'a b' 'it'\\''s'"


def test_precompiled(spark):
    jobs = spark.createDataFrame([("/b", ["gcc", "-include", "p.h", "-include", "q.h", "-include"])], "directory string, argv array<string>")
    out = trace.strip_precompiled(jobs, spark.createDataFrame([("/b/p.h.gch",)], "path string"))
    assert out.first()["argv"] == ["gcc", "-include", "q.h", "-include"]


@pytest.mark.parametrize(("source", "want"), [
    ("'a\n# b", [("'a\n# b", "quoted")]), ("/* c */ #if", [("/* c */", "comment"), (" #", "default"), ("if", "keyword")]),
    ("// a\\\nb\nint", [("// a\\\nb\n", "comment"), ("int", "keyword")]), ("#include <x>", [("#include", "directive"), (" ", "default"), ("<x>", "quoted")]),
    ("0x1._E+.12", [("0x1._E+.12", "number")]), ("#foo", [("#foo", "default")]),
])
def test_syntax(source, want):
    assert [(source[a:b], k) for a, b, k in syntax.kinds(source.encode())] == want


def test_history():
    h = history.History()
    for p in "abcd":
        h.record(p)
    assert (h.step(-1), h.step(-1)) == ("c", "b")
    h.record("b")
    h.record("c")
    assert (h.entries, h.cursor) == (list("abcd"), 2)
    h.record("x")
    assert (h.entries, h.cursor) == (list("abcxd"), 3)
    for i in range(300):
        h.record(str(i))
    assert h.cursor == history.CAP and len(h.entries) == history.CAP + 1 + 1
    assert history.History().step(-1) is None


def test_merge_is_commutative_and_idempotent(spark):
    a = facts(spark, [("@/a", 1, 1, 2, "s", "Read", "Class"), ("@/a", 2, 1, 2, "t", "Definition", "Parameter")])
    b = facts(spark, [("@/b", 1, 1, 2, "s", "Read", "Class")])
    ab, ba, aa = (merge.merge_indexes(*p) for p in ((a, b), (b, a), (a, a)))
    ref = lambda i: rows(i.decoded("Reference"), "*")
    assert ref(ab) == ref(ba) and len(ref(ab)) == 3 and len(ref(aa)) == 2
    assert rows(ab.decoded("GlobalSymbol"), "*") == [("s",)]
    with pytest.raises(ValueError, match="columns"):
        ab.add_table("Reference", a)
    with pytest.raises(ValueError, match="differ"):
        merge.merge_facts(a, a.drop("kind"))


def test_index_round_trip(spark, tmp_path):
    f = facts(spark, [("@/a", i, 1, 2, f"s{i % 3}", "Read", "Class") for i in range(9)])
    index = tables.build_index(f)
    index.write(str(tmp_path / "index"))
    again = tables.CodeIndex.read(spark, str(tmp_path / "index"))
    assert rows(again.decoded("ReferenceIndex"), "*") == rows(index.decoded("ReferenceIndex"), "*")
    merge.write_archive(f, str(tmp_path / "archive"))
    assert layout(spark, str(tmp_path / "archive")) == "archive"
    assert merge.open_archive(spark, str(tmp_path / "archive")).count() == 1
    assert merge.open_entry(spark, str(tmp_path / "archive"), "@/a").count() == 9
    with pytest.raises(ValueError, match="neither"):
        layout(spark, str(tmp_path))


def test_ranked_over_partitions(spark):
    got = dictionary.ranked(spark.range(1000).repartition(7).withColumn("x", F.lpad(F.col("id").cast("string"), 4, "0")), ["x"], "at")
    assert got.where("at <> id").count() == 0


def test_tree(spark):
    t = tree.nodes(spark.createDataFrame([("/project/a/b/c.h",), ("/usr/x",), ("built",), ("/project/z",)], "path string"))
    assert rows(tree.roots(t), "category") == [("External",), ("Project",), ("Special",)]
    assert rows(tree.auto_expanded(t), "category", "path") == [("External", "usr"), ("Project", "a/b")]
    order = [r.path for r in tree.preorder(t).orderBy("row").collect()]
    assert order == ["a", "a/b", "a/b/c.h", "z", "usr", "usr/x", "built"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\rz\n")
    assert text_files(spark, str(tmp_path)).first()["content"] == "x\ny\nz\n"
