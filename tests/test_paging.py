"""Pages of written reports, and lines of files of any size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import text
from lodestone.operators.paging import Paged
from lodestone.operators.report import Report
from lodestone.sources.lines import file_lines
from lodestone.sources.store import clean_text

ROWS = "symbol string, file string, source_row bigint"


@pytest.fixture(scope="module")
def report(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "alpha", "Beta", "gamma", "beta", "delta"]), f"f{rng.randrange(9)}", i) for i in range(900)]
    return Report("Symbols", ("symbol", "file"), spark.createDataFrame(rows, ROWS).repartition(4)), rows


@pytest.fixture(scope="module")
def paged(report, tmp_path_factory):
    return Paged.write(report[0], "symbol", str(tmp_path_factory.mktemp("report") / "r"), 8)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2]))


def got(df):
    return sorted((r.position, r.source_position, r.symbol, r.file, r.source_row) for r in df.collect())


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize(("first", "n"), [(0, 50), (430, 50), (880, 50), (900, 5), (-3, 5), (0, 5000)])
def test_pages(report, paged, descending, first, n):
    view = paged.reversed() if descending else paged
    want = list(enumerate(ordered(report[1])[::-1] if descending else ordered(report[1])))
    page = view.page(first, n)
    assert got(page) == [(i, i, *r) for i, r in want if first <= i < first + n]
    if n == 50:
        assert len(view.files_of(first, n)) <= 3 < len(view.files) and len([f for f in page.inputFiles() if paged.path in f]) <= 3


@pytest.mark.parametrize("descending", [False, True])
def test_filtered_views(report, paged, descending):
    view = paged.filter("symbol", "^b")  # no capital letter: either case matches
    view = view.reversed() if descending else view
    base = ordered(report[1])[::-1] if descending else ordered(report[1])
    want = [(i, r) for i, r in enumerate(base) if r[0] and r[0].lower().startswith("b")]
    assert view.size == len(want)
    assert got(view.page(3, 40)) == [(p, i, *r) for p, (i, r) in list(enumerate(want))[3:43]]
    assert got(view.page(view.size - 2, 40)) == [(p, i, *r) for p, (i, r) in list(enumerate(want))[-2:]]
    assert paged.filter("symbol", "none such").page(0, 9).count() == 0


def test_positions_and_back(spark, report, paged):
    base = ordered(report[1])
    view = paged.filter("file", "f[1-3]")
    kept = [r for r in base if r[1] in ("f1", "f2", "f3")]
    rows = [kept[0], kept[77], next(r for r in base if r[1] == "f8")]
    found = view.positions(spark.createDataFrame([(r[0], r[2]) for r in rows], "symbol string, source_row bigint")).collect()
    assert sorted((r.source_row, r.position, r.source_position) for r in found) == sorted((r[2], kept.index(r), base.index(r)) for r in rows[:2])
    for r in found:  # and back
        assert [x.source_row for x in view.page(r.position, 1).collect()] == [r.source_row]


def test_a_report_without_rows(spark, tmp_path):
    empty = Paged.write(Report("Symbols", ("symbol", "file"), spark.createDataFrame([], ROWS)), "symbol", str(tmp_path / "r"))
    assert empty.size == 0 and empty.files_of(0, 10) == [] and empty.page(0, 10).count() == 0


# --- lines ----------------------------------------------------------------

TEXTS = {
    "a": b"", "b": b"one", "c": b"one\n", "d": b"one\r\ntwo\rthree\n\n", "e": b"\n", "f": b"\r", "g": b"x\r\r\ny", "h": b"x\ny\0z\nw\n", "i": b"x\n\0\n\n", "j": b"x\n\r\0", "k": b"\0x\ny", "l": "é\nü ü\r".encode(), "m": b"a\r\0b\n", "n": b"\r\n\r\n", "o": b"x\r",
    "p": b"".join(bytes(f"line {i}", "ascii") + (b"\r\n", b"\n", b"\r")[i % 3] for i in range(900)), "q": b"y" * 3000 + b"\n" + b"\n".join(b"%d" % i for i in range(600)) + b"\0" + b"more\n" * 400,
}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_lines_of_files(spark, tmp_path, small_splits):
    """Files in many splits give the lines of their whole texts, whatever ends a line."""
    for name, data in TEXTS.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    rows = file_lines(spark, str(tmp_path))
    found = {}
    for r in rows.collect():
        found.setdefault(r.file.rsplit("/", 1)[-1][0], []).append((r.line, r.start, r.len, r.text))
    files = spark.createDataFrame(list(TEXTS.items()), "file string, content binary").select("file", clean_text(F.col("content").cast("string")).alias("content"))
    want = {}
    for r in text.lines(files).collect():
        want.setdefault(r.file, []).append((r.line, r.start, r.len, r.text))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    from lodestone.sources.lines import _pieces, _rows

    assert _pieces(_rows(spark, str(tmp_path))).where("file LIKE '%p.txt'").count() > 5


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert file_lines(spark, str(tmp_path)).count() == 0
