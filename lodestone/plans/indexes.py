"""Registered queries over written indexes, versions and maintained views, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import regex
from lodestone.operators import dictionary, merge, report, tables, xref
from lodestone.operators.maintained import Definitions
from lodestone.operators.paging import Paged
from lodestone.operators.snapshots import Snapshots
from lodestone.plans.oracle import EV, oracle
from lodestone.schema import REFERENCE
from lodestone.sources.facts import event_refs
from lodestone.sources.keyed import Keyed, write_keyed
from lodestone.sources.lines import file_lines
from lodestone.sources.store import shared_dir, table, text_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REF = "file, line, start_col, end_col, symbol, kind"
#: Files of a keyed dataset in the queries.
PARTITIONS = 12


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _keyed(s: SparkSession, d: str, keys: list[str]) -> Keyed:
    path = _folder(s, "keyed")
    write_keyed(event_refs(s, d).select(*REFERENCE).distinct().select(*keys), path, keys, PARTITIONS)
    return Keyed(s, path)


INVERTED = ["symbol", "kind", "file", "line", "start_col", "end_col"]


@query
def written_prefix_lookup(s: SparkSession, d: str) -> DataFrame:
    """All references on every fifth line that is read anywhere, by a prefix of two columns."""
    wanted = event_refs(s, d).where("kind = 'Read' AND line % 5 = 0").select("file", "line")
    return _keyed(s, d, list(REFERENCE)).lookup(wanted)


@query
def written_line_ranges(s: SparkSession, d: str) -> DataFrame:
    """References on some lines of every third day's file."""
    days = event_refs(s, d).select("file").distinct().where(F.dayofmonth(F.substring("file", 6, 10).try_cast("date")) % 3 == 0)
    first = F.dayofmonth(F.substring("file", 6, 10).try_cast("date")).cast("bigint") % 10
    return _keyed(s, d, list(REFERENCE)).lookup(days.select("file", first.alias("line"), (first + 6).alias("last")), upto="last")


@query
def written_lower_bounds(s: SparkSession, d: str) -> DataFrame:
    """The first reference at or after keys that stand in the index, between its entries, and after all of them."""
    wanted = table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), F.when(F.col("event_type") == "click", "Called").otherwise("M").alias("kind"))
    wanted = wanted.unionByName(event_refs(s, d).where("line = 3").select("symbol", "kind")).unionByName(s.range(1).select(F.lit("v").alias("symbol"), F.lit("").alias("kind")))
    found = _keyed(s, d, INVERTED).lower_bounds(wanted)
    return found.select("symbol", "kind", *(F.col(f"found.{c}").alias(f"at_{c}") for c in INVERTED))


@query
def written_symbol_references(s: SparkSession, d: str) -> DataFrame:
    """A built index is written; the references of one symbol per user are read from it through its dictionary."""
    path = _folder(s, "index")
    tables.build_index(event_refs(s, d), once=True).write(path)
    wanted = table(s, d, "events").groupBy("user_id").agg(F.min(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
    return tables.written_references(s, path, wanted.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("::k"), F.col("k").cast("string")).alias("symbol")))


def _snapshots(s: SparkSession, d: str) -> Snapshots:
    """Four versions: half of the lines; later days anew; the same batch again; the days from 25 on retired."""
    facts = event_refs(s, d).select(*REFERENCE).distinct()
    day = F.dayofmonth(F.substring("file", 6, 10).try_cast("date"))
    names = lambda df: df.select(F.col("file").alias("entry")).distinct()
    store = Snapshots(s, _folder(s, "snapshots"))
    store.refresh(facts.where("line < 12"), names(facts), "first")
    stale = facts.where(day > 20)
    store.refresh(stale, names(stale), "second")
    store.refresh(stale, names(stale), "second")
    store.refresh(facts.where(day > 30).limit(0), names(facts.where(day >= 25)), "third")
    return store


@query
def snapshot_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts of every version, the last and the earlier ones."""
    store = _snapshots(s, d)
    out = None
    for v in store.versions():
        own = store.facts(v).withColumn("version", F.lit(v).cast("bigint"))
        out = own if out is None else out.unionByName(own)
    return out


@query
def snapshot_log(s: SparkSession, d: str) -> DataFrame:
    """Entries that each version wrote and retired."""
    log = _snapshots(s, d).log()
    return log.groupBy("version").agg(F.count_if(F.col("part").isNotNull()).alias("written"), F.count_if(F.col("part").isNull()).alias("retired"))


def _maintained(s: SparkSession, d: str) -> Definitions:
    """Three batches: two thirds of all facts come; the rest comes and every fifth goes; some of those come back, some others go; the second batch comes twice."""
    facts = event_refs(s, d).withColumn("m", F.col("line") * 7 + F.col("start_col") * 3 + F.col("end_col"))
    signed = lambda on, sign: facts.where(on).withColumn("sign", F.lit(sign))
    view = Definitions(s, _folder(s, "definitions"), buckets=4)
    view.apply(signed("m % 3 <> 0", 1), 1)
    second = signed("m % 3 = 0", 1).unionByName(signed("m % 3 <> 0 AND m % 5 = 0", -1))
    view.apply(second, 2)
    view.apply(second, 2)
    view.apply(signed("m % 15 = 5", 1).unionByName(signed("m % 3 = 0 AND m % 4 = 1", -1)), 3)
    return view


@query
def maintained_definitions(s: SparkSession, d: str) -> DataFrame:
    return _maintained(s, d).single()


@query
def maintained_globals(s: SparkSession, d: str) -> DataFrame:
    return _maintained(s, d).global_definitions()


@query
def report_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of one written report: from its middle, from its end in falling order, of two filtered views."""
    whole = Paged.write(report.definition_report(xref.global_definitions(event_refs(s, d))), "symbol", _folder(s, "report"), PARTITIONS)
    few = whole.filter("symbol", "k[1-3]$")
    pages = {"middle": whole.page(100, 50), "end": whole.reversed().page(0, 20), "filtered": few.page(5, 30), "filtered end": few.reversed().page(3, 10)}
    out = None
    for name, page in pages.items():
        own = page.select(F.lit(name).alias("page"), "position", "source_position", "symbol", "file")
        out = own if out is None else out.unionByName(own)
    return out


@query
def report_positions(s: SparkSession, d: str) -> DataFrame:
    """Positions of some symbols' definitions in a filtered view and in the whole report."""
    whole = Paged.write(report.definition_report(xref.global_definitions(event_refs(s, d))), "symbol", _folder(s, "report"), PARTITIONS)
    wanted = table(s, d, "events").groupBy("user_id").agg(F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
    wanted = wanted.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("::k"), F.col("k").cast("string")).alias("symbol"))
    return whole.filter("symbol", "[02468]$").positions(wanted)


@query
def disk_lines(s: SparkSession, d: str) -> DataFrame:
    """Texts of a hundred ids each are written as files with three kinds of line ends; their lines are read from the folder."""
    docs = table(s, d, "documents").where("text IS NOT NULL").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r")).alias("value"))
    path = _folder(s, "files")
    docs.repartition("part").sortWithinPartitions("part", "doc_id", "value").select("part", "value").write.partitionBy("part").text(path)
    rows = file_lines(s, path)
    return rows.select(F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("bigint").alias("part"), "line", "start", "len", F.md5("text").alias("text"))


@query
def index_dump(s: SparkSession, d: str) -> DataFrame:
    """The written Reference table as JSON, with values for ids."""
    path = _folder(s, "index")
    tables.build_index(event_refs(s, d), once=True).write(path)
    return merge.dump(tables.CodeIndex.read(s, path), "Reference")


@query
def index_catalogue(s: SparkSession, d: str) -> DataFrame:
    """Tables and dictionaries of a written index, by name: rows, bytes of values, values in hash buckets."""
    path = _folder(s, "index")
    tables.build_index(event_refs(s, d), once=True).write(path)
    index = tables.CodeIndex.read(s, path)
    out = None
    for name in index.table_names():
        own = index.table(name).agg(F.lit("table").alias("part"), F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("bigint").alias("in_buckets"))
        out = own if out is None else out.unionByName(own)
    for name in index.dictionary_names():
        values = index.dictionaries[name]
        buckets = dictionary.bucket_stats(values, 64).agg(F.sum("n").alias("in_buckets"))
        out = out.unionByName(dictionary.item_stats(values).join(F.broadcast(buckets)).select(F.lit("dictionary").alias("part"), F.lit(name).alias("name"), "n", "bytes", "in_buckets"))  # one row each
    return out


@query
def filters_as_typed(s: SparkSession, d: str) -> DataFrame:
    """Symbols under what was typed last, where an invalid pattern leaves the former one in force."""
    symbols, out, filter_ = xref.all_symbols(event_refs(s, d)), None, ""
    for step, typed in enumerate(("", "u1", "u1(", "U1", "[", "k7$")):
        filter_ = regex.next_filter(s, typed, filter_)
        own = symbols.where(regex.report_filter(F.col("symbol"), filter_)).agg(F.lit(step).cast("bigint").alias("step"), F.lit(filter_).alias("in_force"), F.count("*").alias("n"), F.min("symbol").alias("first"))
        out = own if out is None else out.unionByName(own)
    return out


@query
def disk_files(s: SparkSession, d: str) -> DataFrame:
    """Whole texts of files in a folder, by the hashes of their normalised contents."""
    docs = table(s, d, "documents").where("text IS NOT NULL").select(F.floor(F.col("doc_id") / 10).alias("part"), "doc_id", F.replace("text", F.lit(". "), F.lit(".\r\n")).alias("value"))
    path = _folder(s, "files")
    docs.repartition("part").sortWithinPartitions("part", "doc_id", "value").select("part", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part").text(path)  # tasks move their own files; the folder is new
    rows = text_files(s, path).where("error IS NULL")
    return rows.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("bigint").alias("part"), F.octet_length("content").cast("bigint").alias("bytes"), F.md5("content").alias("content"))


oracle("written_prefix_lookup", f"SELECT {REF} FROM r WHERE (file, line) IN (SELECT (file, line) FROM ev WHERE kind = 'Read' AND line % 5 = 0)", EV)
_DAY = "day(CAST(substr(file, 6) AS DATE))"
oracle("written_line_ranges", f"SELECT {REF} FROM r WHERE {_DAY} % 3 = 0 AND line BETWEEN {_DAY} % 10 AND {_DAY} % 10 + 6", EV)
oracle(
    "written_lower_bounds",
    """SELECT symbol, kind, x.symbol AS at_symbol, x.kind AS at_kind, x.file AS at_file, x.line AS at_line, x.start_col AS at_start_col, x.end_col AS at_end_col FROM
(SELECT w.symbol, w.kind, min({symbol: r.symbol, kind: r.kind, file: r.file, line: r.line, start_col: r.start_col, end_col: r.end_col}) AS x FROM w LEFT JOIN r ON r.symbol > w.symbol OR r.symbol = w.symbol AND r.kind >= w.kind GROUP BY w.symbol, w.kind)""",
    EV, "w AS (SELECT 'u' || user_id AS symbol, CASE WHEN event_type = 'click' THEN 'Called' ELSE 'M' END AS kind FROM events UNION SELECT symbol, kind FROM ev WHERE line = 3 UNION SELECT 'v', '')",
)
oracle("written_symbol_references", f"SELECT {REF} FROM r WHERE symbol IN (SELECT 'u' || user_id || '::k' || min(k) FROM e0 GROUP BY user_id)", EV)
_VERSIONS = f"""SELECT {REF}, 1 AS version FROM r WHERE line < 12 UNION ALL SELECT {REF}, 2 FROM r WHERE line < 12 OR {_DAY} > 20 UNION ALL SELECT {REF}, 3 FROM r WHERE {_DAY} < 25 AND (line < 12 OR {_DAY} > 20)"""
oracle("snapshot_facts", f"SELECT {REF}, CAST(version AS BIGINT) AS version FROM ({_VERSIONS})", EV)
oracle(
    "snapshot_log",
    f"""SELECT CAST(1 AS BIGINT) AS version, count(DISTINCT file) AS written, CAST(0 AS BIGINT) AS retired FROM r WHERE line < 12 HAVING written > 0 UNION ALL
SELECT 2, count(DISTINCT file), 0 FROM r WHERE {_DAY} > 20 AND file IN (SELECT file FROM r WHERE line >= 12) HAVING count(*) > 0 UNION ALL SELECT 3, 0, count(DISTINCT file) FROM r WHERE {_DAY} >= 25 HAVING count(*) > 0""",
    EV,
)
KEPT = """kp AS (SELECT file, line, start_col, end_col, symbol, kind, symbol_type FROM (SELECT *, line * 7 + start_col * 3 + end_col AS m FROM ev)
  WHERE (m % 3 <> 0 AND m % 5 <> 0) OR m % 15 = 5 OR (m % 3 = 0 AND m % 4 <> 1)),
kr AS (SELECT DISTINCT file, line, start_col, end_col, symbol, kind FROM kp)"""
oracle(
    "maintained_definitions",
    """SELECT symbol, nd AS n_def, nc AS n_decl, p.file AS file, p.line AS line, p.start_col AS start_col, p.end_col AS end_col, p.kind AS kind FROM
(SELECT symbol, nd, nc, CASE WHEN nd = 1 THEN d WHEN nd = 0 AND nc = 1 THEN c END AS p FROM (SELECT symbol, count(*) FILTER (kind = 'Definition') AS nd, count(*) FILTER (kind = 'Declaration') AS nc,
  min({file: file, line: line, start_col: start_col, end_col: end_col, kind: kind}) FILTER (kind = 'Definition') AS d, min({file: file, line: line, start_col: start_col, end_col: end_col, kind: kind}) FILTER (kind = 'Declaration') AS c FROM kr GROUP BY symbol)
 WHERE nd > 0 OR nc > 0)""",
    EV, KEPT,
)
oracle("maintained_globals", f"SELECT {REF} FROM kr WHERE kind = 'Definition' AND symbol IN (SELECT symbol FROM kp WHERE symbol_type NOT IN ('LocalVariable', 'Parameter', 'Path'))", EV, KEPT)
GD = """gq AS (SELECT symbol, file, row_number() OVER (ORDER BY symbol, file, line, start_col, end_col) - 1 AS spot, count(*) OVER () AS n FROM gd),
fq AS (SELECT *, row_number() OVER (ORDER BY spot) - 1 AS own, count(*) OVER () AS m FROM gq WHERE regexp_matches(symbol, 'k[1-3]$'))"""
oracle(
    "report_pages",
    """SELECT 'middle' AS page, spot AS position, spot AS source_position, symbol, file FROM gq WHERE spot BETWEEN 100 AND 149 UNION ALL SELECT 'end', n - 1 - spot, n - 1 - spot, symbol, file FROM gq WHERE n - 1 - spot < 20
UNION ALL SELECT 'filtered', own, spot, symbol, file FROM fq WHERE own BETWEEN 5 AND 34 UNION ALL SELECT 'filtered end', m - 1 - own, n - 1 - spot, symbol, file FROM fq WHERE m - 1 - own BETWEEN 3 AND 12""",
    EV, GD,
)
oracle(
    "report_positions",
    "SELECT symbol, own AS position, spot AS source_position FROM (SELECT *, row_number() OVER (ORDER BY spot) - 1 AS own FROM gq WHERE regexp_matches(symbol, '[02468]$')) WHERE symbol IN (SELECT 'u' || user_id || '::k' || max(k) FROM e0 GROUP BY user_id)",
    EV, GD,
)
oracle(
    "disk_lines",
    """SELECT part, i - 1 AS line, CAST(sum(strlen(l) + 1) OVER (PARTITION BY part ORDER BY i) - strlen(l) - 1 AS BIGINT) AS start, CAST(strlen(l) AS BIGINT) AS len, md5(l) AS text FROM (SELECT part, unnest(ls[:-2]) AS l, unnest(range(1, len(ls))) AS i FROM f)""",
    """f AS (SELECT doc_id // 100 AS part, string_split(replace(replace(string_agg(text || chr(10), '' ORDER BY doc_id, text), '. ', '.' || chr(10)), ', ', ',' || chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 100)""",
)
oracle("index_dump", """SELECT '{"file":"' || file || '","line":' || line || ',"start_col":' || start_col || ',"end_col":' || end_col || ',"symbol":"' || symbol || '","kind":"' || kind || '"}' AS json FROM r""", EV)
oracle(
    "index_catalogue",
    """SELECT 'table' AS part, unnest(['Reference', 'ReferenceIndex']) AS name, (SELECT count(*) FROM r) AS n, NULL AS bytes, NULL AS in_buckets UNION ALL SELECT 'table', unnest(['Symbol', 'SymbolTypeIndex']), (SELECT count(*) FROM sy), NULL, NULL
UNION ALL SELECT 'table', 'GlobalSymbol', (SELECT count(*) FROM gs), NULL, NULL UNION ALL SELECT 'dictionary', 'Symbol', count(*), CAST(sum(strlen(symbol) + 1) AS BIGINT), count(*) FROM (SELECT DISTINCT symbol FROM sy)
UNION ALL SELECT 'dictionary', 'SymbolType', count(*), CAST(sum(strlen(symbol_type) + 1) AS BIGINT), count(*) FROM (SELECT DISTINCT symbol_type FROM sy) UNION ALL SELECT 'dictionary', 'ReferenceType', count(*), CAST(sum(strlen(kind) + 1) AS BIGINT), count(*) FROM (SELECT DISTINCT kind FROM r WHERE kind IS NOT NULL)""",
    EV,
)
_TYPED = {0: ("", "true"), 1: ("u1", "s ILIKE '%u1%'"), 2: ("u1", "s ILIKE '%u1%'"), 3: ("U1", "s LIKE '%U1%'"), 4: ("U1", "s LIKE '%U1%'"), 5: ("k7$", "s ILIKE '%k7'")}
oracle("filters_as_typed", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, '{f}' AS in_force, count(*) AS n, min(s) AS first FROM als WHERE {on}" for i, (f, on) in _TYPED.items()), EV, "als AS (SELECT symbol AS s FROM ev UNION SELECT file FROM ev)")
oracle(
    "disk_files",
    "SELECT part, CAST(strlen(c) AS BIGINT) AS bytes, md5(c) AS content FROM (SELECT doc_id // 10 AS part, replace(string_agg(text || chr(10), '' ORDER BY doc_id, text), '. ', '.' || chr(10)) AS c FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 10)",
)
