"""DuckDB equivalents of the registered source-facts queries."""

from __future__ import annotations

from lodestone.operators import syntax, trace

ORACLE_SQL: dict[str, str] = {}

EV = """e0 AS (SELECT ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT '@/ev/' || strftime(ts, '%Y-%m-%d') AS file, CAST(hour(ts) AS BIGINT) + 1 AS line, CAST(minute(ts) AS BIGINT) + 1 AS start_col,
  CAST(minute(ts) AS BIGINT) + 1 + k % 7 + 1 AS end_col, 'u' || user_id || '::k' || k AS symbol,
  CASE event_type WHEN 'signup' THEN 'Definition' WHEN 'view' THEN 'Declaration' WHEN 'click' THEN 'Called' WHEN 'purchase' THEN 'Modified' WHEN 'error' THEN 'Read' END AS kind,
  CASE user_id % 6 WHEN 0 THEN 'Class' WHEN 1 THEN 'Function' WHEN 2 THEN 'Method' WHEN 3 THEN 'Field' WHEN 4 THEN 'LocalVariable' ELSE 'Parameter' END AS symbol_type FROM e0),
r AS (SELECT DISTINCT file, line, start_col, end_col, symbol, kind FROM ev),
sy AS (SELECT DISTINCT symbol, symbol_type FROM ev UNION SELECT DISTINCT file, 'Path' FROM ev),
gs AS (SELECT DISTINCT symbol FROM sy WHERE symbol_type NOT IN ('LocalVariable', 'Parameter', 'Path')),
gd AS (SELECT * FROM r WHERE kind = 'Definition' AND symbol IN (SELECT symbol FROM gs))"""
LI = """li AS (SELECT '@/w/' || lower(substr(o_orderpriority, 3)) || '/' || l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_quantity) AS BIGINT) AS start_col,
  CAST(floor(l_quantity) AS BIGINT) + 1 + l_partkey % 5 AS end_col, 'part_' || l_partkey AS symbol,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Definition' WHEN 'RF' THEN 'Declaration' WHEN 'NO' THEN 'Called' ELSE 'Read' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lr AS (SELECT DISTINCT file, line, start_col, end_col, symbol, kind FROM li)"""
DOC = """df AS (SELECT doc_id, '@/' || source || '/' || lang || '/' || doc_id || '.txt' AS file, text AS content FROM documents),
dl0 AS (SELECT file, CASE WHEN content = '' THEN [] WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS ls FROM df),
dl1 AS (SELECT file, ls, unnest(range(1, len(ls) + 1)) AS i FROM dl0),
dl2 AS (SELECT file, i - 1 AS line, ls[i] AS text, CAST(strlen(ls[i]) AS BIGINT) AS len FROM dl1),
dl AS (SELECT file, line, CAST(sum(len + 1) OVER (PARTITION BY file ORDER BY line) - len - 1 AS BIGINT) AS start, len, text FROM dl2)"""
MATCH = """m0 AS (SELECT file, regexp_extract_all(content, '(?im)the[a-z]* of') AS ms, string_split_regex(content, '(?im)the[a-z]* of') AS gs FROM df),
m1 AS (SELECT file, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m0),
m AS (SELECT file, i - 1 AS idx, CAST(list_sum(list_transform(gs[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS start,
  CAST(strlen(ms[i]) AS BIGINT) AS len FROM m1)"""
PG = """pp AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN '/project/' || p WHEN 1 THEN '/' || p ELSE p END AS path
  FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)),
pc AS (SELECT path, CASE WHEN starts_with(path, '/project/') THEN 'Project' WHEN starts_with(path, '/') THEN 'External' ELSE 'Special' END AS category FROM pp),
ps AS (SELECT DISTINCT category, string_split(CASE category WHEN 'Project' THEN substr(path, 10) WHEN 'External' THEN substr(path, 2) ELSE path END, '/') AS p FROM pc),
pe AS (SELECT category, p, unnest(range(1, len(p) + 1)) AS i FROM ps),
tn AS (SELECT DISTINCT category, array_to_string(p[1:i], '/') AS path, coalesce(array_to_string(p[1:i - 1], '/'), '') AS parent, i AS depth, i = len(p) AS is_file, p[i] AS title FROM pe)"""


def _text(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_text, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def oracle(name: str, body: str, *prefix: str) -> None:
    ORACLE_SQL[name] = ("WITH RECURSIVE " + ",\n".join(prefix) + "\n" if prefix else "") + body


REF = "file, line, start_col, end_col, symbol, kind"
BUSY = "busy AS (SELECT symbol FROM ev GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1)"
oracle("refs_of_symbol", f"SELECT {REF} FROM r WHERE symbol IN (SELECT symbol FROM busy)", EV, BUSY)
oracle("refs_of_missing_symbol", "SELECT count(*) AS n FROM r WHERE symbol = 'no such symbol'", EV)
oracle("refs_of_symbol_report", "SELECT row_number() OVER (ORDER BY kind, file, line, start_col, end_col) - 1 AS position, file, line, kind FROM r WHERE symbol IN (SELECT symbol FROM busy)", EV, BUSY)
oracle("file_refs_range", f"SELECT {REF} FROM r WHERE file = (SELECT min(file) FROM ev) AND line BETWEEN 5 AND 12", EV)
oracle("prefix_lower_bound", f"SELECT {REF} FROM r WHERE symbol >= 'u5' ORDER BY symbol, file, line, start_col, end_col, kind LIMIT 1", EV)
oracle("reverse_scan_topk", f"SELECT {REF}, row_number() OVER (ORDER BY file DESC, line DESC, start_col DESC, end_col DESC, symbol DESC, kind DESC) AS position FROM r QUALIFY position <= 25", EV)
oracle("all_paths", "SELECT row_number() OVER (ORDER BY path) - 1 AS id, path FROM (SELECT DISTINCT substr(file, 2) AS path FROM ev)", EV)
oracle("all_symbols", "SELECT row_number() OVER (ORDER BY symbol) - 1 AS id, symbol FROM (SELECT symbol FROM ev UNION SELECT file FROM ev)", EV)
SD = """sd0 AS (SELECT symbol, count(*) FILTER (kind = 'Definition') AS n_def, count(*) FILTER (kind = 'Declaration') AS n_decl,
  min({file: file, line: line, start_col: start_col, end_col: end_col, kind: kind}) FILTER (kind = 'Definition') AS d,
  min({file: file, line: line, start_col: start_col, end_col: end_col, kind: kind}) FILTER (kind = 'Declaration') AS c FROM r GROUP BY symbol),
sd1 AS (SELECT symbol, n_def, n_decl, CASE WHEN n_def = 1 THEN d WHEN n_def = 0 AND n_decl = 1 THEN c END AS p FROM sd0),
sd AS (SELECT symbol, n_def, n_decl, p.file AS file, p.line AS line, p.start_col AS start_col, p.end_col AS end_col, p.kind AS kind FROM sd1)"""
oracle("single_definition", "SELECT * FROM sd", EV, SD)
oracle(
    "single_definition_path",
    """SELECT DISTINCT file AS symbol, file, CAST(1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS start_col, CAST(1 AS BIGINT) AS end_col, CAST(NULL AS VARCHAR) AS kind FROM ev
UNION ALL SELECT symbol, file, line, start_col, end_col, kind FROM sd WHERE file IS NOT NULL""",
    EV, SD,
)
oracle("global_definitions", f"SELECT {REF} FROM gd", EV)
oracle("non_local_filter", "SELECT symbol FROM gs", EV)
oracle("first_definition", f"SELECT {REF} FROM lr WHERE kind = 'Definition' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY file, line, start_col, end_col) = 1", LI)
TYPED = """ty0 AS (SELECT symbol, symbol_type, CAST(regexp_extract(symbol, 'k([0-9]+)$', 1) AS BIGINT) AS k FROM ev),
ty AS (SELECT symbol, max(CASE WHEN k = 0 THEN NULL WHEN k % 2 = 0 THEN greatest(symbol_type, 'Macro') ELSE symbol_type END) AS symbol_type FROM ty0 GROUP BY symbol)"""
oracle("symbol_types", "SELECT symbol, symbol_type FROM ty", EV, TYPED)
oracle("symbols_report", "SELECT row_number() OVER (ORDER BY symbol_type NULLS FIRST, symbol) - 1 AS position, symbol, symbol_type FROM ty", EV, TYPED)
oracle("files_report", "SELECT row_number() OVER (ORDER BY path) - 1 AS position, path FROM (SELECT DISTINCT substr(file, 2) AS path FROM ev)", EV)
oracle("defs_report_sorted_desc", "SELECT row_number() OVER (ORDER BY file DESC, symbol DESC, line DESC, start_col DESC, end_col DESC) - 1 AS position, symbol, file FROM gd", EV)
oracle("report_page", "SELECT row_number() OVER (ORDER BY symbol, file, line, start_col, end_col) - 1 AS position, symbol, file FROM gd QUALIFY position BETWEEN 100 AND 149", EV)
oracle("report_regex_filter_smartcase_lower", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?im)^(the|der) a')")
oracle("report_regex_filter_smartcase_upper", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?m)^(The|Der) a')")
oracle("report_regex_filter_symbols", "SELECT symbol FROM (SELECT symbol FROM ev UNION SELECT file FROM ev) WHERE regexp_matches(symbol, '(?im)k(7|9)$')", EV)
oracle("report_filter_empty", "SELECT symbol FROM ev UNION SELECT file FROM ev", EV)
oracle("report_column_widths", "SELECT greatest(coalesce(max(length(symbol)), 0), 6) AS w_symbol, greatest(coalesce(max(length(file)), 0), 4) AS w_file FROM gd", EV)
POINTS = "pt AS (SELECT DISTINCT file, line, start_col AS col FROM ev UNION SELECT DISTINCT file, line, start_col + 1 FROM ev)"
BEST = """ps1 AS (SELECT pt.file, pt.line, pt.col, r.start_col, r.end_col, r.symbol, r.kind FROM pt JOIN r ON pt.file = r.file AND pt.line = r.line AND r.start_col <= col AND col < r.end_col
  QUALIFY row_number() OVER (PARTITION BY pt.file, pt.line, pt.col ORDER BY r.start_col DESC, r.end_col, r.symbol, r.kind) = 1)"""
oracle("point_in_span_best", "SELECT * FROM ps1", EV, POINTS, BEST)
SPANS = "ss AS (SELECT file, line, start_col, end_col, list_sort(list(DISTINCT symbol)) AS symbols FROM r GROUP BY ALL)"
oracle("symbols_at_span", "SELECT file, line, start_col, end_col, array_to_string(symbols, ',') AS symbols FROM ss", EV, SPANS)
oracle(
    "click_to_definition",
    """SELECT ps1.file, ps1.line, ps1.col, ss.symbols[1] AS symbol, sd.file AS to_file, sd.line AS to_line, sd.start_col AS to_col
FROM ps1 JOIN ss USING (file, line, start_col, end_col) JOIN sd ON sd.symbol = ss.symbols[1] WHERE len(ss.symbols) = 1 AND sd.file IS NOT NULL""",
    EV, POINTS, BEST, SPANS, SD,
)
oracle(
    "span_end_rule",
    """SELECT DISTINCT file, line, start_col, CASE WHEN x = start_col THEN start_col + 1 ELSE x END AS end_col FROM
(SELECT file, line, start_col, CASE WHEN start_col % 7 = 0 THEN start_col ELSE greatest(start_col, end_col - 4) END AS x FROM li)""",
    LI,
)
IDS = "ids AS (SELECT symbol AS value, dense_rank() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT symbol FROM ev))"
oracle("dict_encode", "SELECT id, value FROM ids", EV, IDS)
oracle("dict_decode_roundtrip", "SELECT DISTINCT file, line, id AS symbol_id, symbol FROM ev JOIN ids ON symbol = value", EV, IDS)
oracle("dict_lookup", "SELECT id, value FROM (SELECT kind AS value, row_number() OVER (ORDER BY kind) - 1 AS id FROM (SELECT DISTINCT kind FROM ev)) WHERE value = 'Called'", EV)
oracle("table_distinct", f"SELECT {REF} FROM r", EV)
MG = """mg AS (SELECT * FROM r WHERE day(CAST(substr(file, 6) AS DATE)) % 2 = 0 OR day(CAST(substr(file, 6) AS DATE)) % 3 <> 0),
mk AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS id FROM (SELECT DISTINCT kind FROM mg)),
ms AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT symbol FROM mg UNION SELECT file FROM mg))"""
oracle("merge_indexes", "SELECT f.id AS file_id, line, start_col, end_col, s.id AS symbol_id, mk.id AS kind_id FROM mg JOIN ms f ON mg.file = f.symbol JOIN ms s ON mg.symbol = s.symbol JOIN mk USING (kind)", EV, MG)
oracle(
    "merge_id_map",
    "SELECT o.id AS old_id, ids.id AS new_id FROM (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT symbol FROM ev WHERE day(CAST(substr(file, 6) AS DATE)) % 2 = 0)) o JOIN ids ON o.symbol = ids.value",
    EV, IDS,
)
oracle("invert_reference", f"SELECT {REF}, row_number() OVER (ORDER BY symbol, kind, file, line, start_col, end_col) - 1 AS position FROM r", EV)
oracle("invert_symbol", "SELECT symbol_type, symbol, row_number() OVER (ORDER BY symbol_type, symbol) - 1 AS position FROM sy", EV)
HASHES = """hb AS (SELECT file, (row_number() OVER (PARTITION BY file ORDER BY x) - 1) // 4096 AS b, x FROM (SELECT file, concat_ws('|', file, line, start_col, end_col, symbol, kind) AS x FROM r)),
hc AS (SELECT file, b, sha256(string_agg(x, chr(10) ORDER BY x)) AS h, count(*) AS n FROM hb GROUP BY file, b),
he AS (SELECT file AS name, sha256(string_agg(h, chr(10) ORDER BY b)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM hc GROUP BY file)"""
oracle("archive_manifest", "SELECT name, hash, n FROM he", EV, HASHES)
oracle("archive_dedup", "SELECT sha256(content) AS hash, doc_id, file FROM df QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id) = 1", DOC)
oracle("archive_open_entry", f"SELECT {REF} FROM r WHERE file = (SELECT min(file) FROM ev)", EV)
oracle("archive_merge", f"SELECT {REF} FROM r", EV)
oracle(
    "catalog_stats",
    """SELECT 'dictionary' AS part, 'ReferenceType' AS name, count(*) AS n, CAST(sum(strlen(kind) + 1) AS BIGINT) AS bytes FROM (SELECT DISTINCT kind FROM ev)
UNION ALL SELECT 'dictionary', 'Symbol', count(*), CAST(sum(strlen(symbol) + 1) AS BIGINT) FROM (SELECT DISTINCT symbol FROM sy)
UNION ALL SELECT 'dictionary', 'SymbolType', count(*), CAST(sum(strlen(symbol_type) + 1) AS BIGINT) FROM (SELECT DISTINCT symbol_type FROM sy)
UNION ALL SELECT 'table', 'GlobalSymbol', count(*), NULL FROM gs UNION ALL SELECT 'table', 'Reference', count(*), NULL FROM r UNION ALL SELECT 'table', 'ReferenceIndex', count(*), NULL FROM r
UNION ALL SELECT 'table', 'Symbol', count(*), NULL FROM sy UNION ALL SELECT 'table', 'SymbolTypeIndex', count(*), NULL FROM sy""",
    EV,
)
oracle("dump_denormalized", f"SELECT {REF} FROM r", EV)
oracle("index_type_lookup", "SELECT 'Path' AS type, file AS symbol FROM (SELECT DISTINCT file FROM ev)", EV)
_width = " + ".join(f"(CASE WHEN {v} + 1 >= {1 << k} THEN 1 ELSE 0 END)" for v in ("line", "start_col * 3000", "length(file) * 400000") for k in (7, 14, 21, 28))
oracle("vle_row_size", f"SELECT CAST(4 + {_width} AS BIGINT) AS bytes, count(*) AS n FROM li GROUP BY 1", LI)
oracle(
    "incremental_stale",
    """SELECT 'none' AS index_file, false AS reusable UNION ALL
SELECT index_file, bool_and(mtime <= 20) FROM (SELECT 'idx' || line % 5 AS index_file, file, day(CAST(substr(file, 6) AS DATE)) AS mtime FROM ev) WHERE index_file <> 'idx3' OR file < '@/ev/2024-01-10' GROUP BY index_file
UNION ALL SELECT 'idx3', true WHERE NOT EXISTS (SELECT 1 FROM ev WHERE line % 5 = 3 AND file < '@/ev/2024-01-10')""",
    EV,
)
oracle("line_table", "SELECT file, line, start, len, text FROM dl", DOC)
oracle(
    "offset_to_line",
    """SELECT o.file, o.off AS "offset", max(line) AS line, o.off - max(start) AS col FROM (SELECT file, unnest([0, 57, 311]::BIGINT[]) AS off, strlen(content) AS n FROM df) o JOIN dl ON o.file = dl.file AND start <= o.off WHERE o.off <= o.n GROUP BY o.file, o.off""",
    DOC,
)
oracle("location_to_offset", 'SELECT file, line, CAST(40 AS BIGINT) AS col, start + least(40, len) AS "offset" FROM dl', DOC)
oracle("longest_line", "SELECT df.file, coalesce(max(len), 0) AS width FROM df LEFT JOIN dl USING (file) GROUP BY df.file", DOC)
oracle(
    "tab_expanded_length",
    "SELECT line, w AS width FROM w WHERE i = len(c)",
    DOC, "t AS (SELECT DISTINCT replace(text, ' ', chr(9)) AS line, string_split(replace(text, ' ', chr(9)), chr(9)) AS c FROM dl)",
    "w AS (SELECT line, c, 1 AS i, CAST(strlen(c[1]) AS BIGINT) AS w FROM t UNION ALL SELECT line, c, i + 1, CAST((w // 8 + 1) * 8 + strlen(c[i + 1]) AS BIGINT) FROM w WHERE i < len(c))",
)
CHARS = """ch0 AS (SELECT file, line, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM dl WHERE text <> ''),
ch AS (SELECT file, line, i, c, strlen(c) AS n, sum(strlen(c)) OVER (PARTITION BY file, line ORDER BY i) AS e, regexp_matches(c, '^[A-Za-z0-9_]$') AS is_word FROM ch0)"""
oracle(
    "word_at_position",
    """SELECT g.file, g.line, col, CASE WHEN is_word THEN word ELSE c END AS word FROM
(SELECT file, line, c, is_word, n, e, sum(CASE WHEN is_word THEN 0 ELSE 1 END) OVER (PARTITION BY file, line ORDER BY i) AS k FROM ch) g
JOIN (VALUES (CAST(0 AS BIGINT)), (9), (23)) AS v(col) ON e - n <= col AND col < e
LEFT JOIN (SELECT file, line, k, string_agg(c, '' ORDER BY i) AS word FROM (SELECT *, sum(CASE WHEN is_word THEN 0 ELSE 1 END) OVER (PARTITION BY file, line ORDER BY i) AS k FROM ch) WHERE is_word GROUP BY file, line, k) w
ON g.file = w.file AND g.line = w.line AND g.k = w.k""",
    DOC, CHARS,
)
oracle("find_in_file_matches", "SELECT file, idx, start, len FROM m", DOC, MATCH)
oracle(
    "match_next_prev",
    """SELECT file, idx, start, coalesce(lead(start) OVER (PARTITION BY file ORDER BY idx), first(start) OVER (PARTITION BY file ORDER BY idx)) AS next_start,
  coalesce(lag(start) OVER (PARTITION BY file ORDER BY idx), last(start) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_start FROM m""",
    DOC, MATCH,
)
oracle(
    "match_best_index",
    """SELECT file, s AS find_start, p AS previous, CAST(CASE
  WHEN p <> -1 THEN CASE WHEN (s <= p AND ct >= s AND ct <= p) OR (s > p AND (ct >= s OR ct <= p)) THEN ci ELSE coalesce(after_, 0) END
  WHEN s <> -1 THEN coalesce(from_start, 0) ELSE 0 END AS BIGINT) AS best FROM
(SELECT file, s, p, coalesce(max(idx) FILTER (start <= p), max(idx)) AS ci, coalesce(max(start) FILTER (start <= p), max(start)) AS ct, min(idx) FILTER (start >= p) AS after_, min(idx) FILTER (start >= s) AS from_start
 FROM m, (VALUES (CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)), (200, -1), (100, 400), (600, 300), (0, 1000000000)) AS v(s, p) GROUP BY file, s, p)""",
    DOC, MATCH,
)
oracle("match_label", "SELECT file, CASE WHEN n > 3 THEN '3 of ' || n WHEN n = 1 THEN '1 match' ELSE n || ' matches' END AS label FROM (SELECT df.file, count(m.idx) AS n FROM df LEFT JOIN m USING (file) GROUP BY df.file)", DOC, MATCH)
_colour = "CASE symbol_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in syntax.SYMBOL_COLOURS.items()) + " END"
oracle(
    "color_overlay",
    f"""SELECT file, line, col, c.colour AS colour FROM (SELECT file, line, col, max({{a: start_col, b: end_col, c: symbol, d: kind, colour: colour}}) AS c FROM
(SELECT DISTINCT file, line, start_col, end_col, symbol, kind, {_colour} AS colour, unnest(range(start_col, end_col)) AS col FROM ev) WHERE colour IS NOT NULL GROUP BY file, line, col)""",
    EV,
)
oracle("keyword_lookup", f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(content, '[^A-Za-z0-9_]+')) AS word FROM df) WHERE word IN ({', '.join(_text(k) for k in sorted(syntax.KEYWORDS))}) GROUP BY word", DOC)
oracle("path_categories", "SELECT path, category FROM pc", PG)
oracle("path_tree", "SELECT category, path, parent, depth, is_file, title FROM tn", PG)
SINGLE = "sg AS (SELECT category, parent FROM tn GROUP BY category, parent HAVING count(*) FILTER (NOT is_file) = 1 AND count(*) FILTER (is_file) = 0), ax AS (SELECT category, path FROM tn SEMI JOIN sg USING (category, parent) WHERE NOT is_file)"
oracle("folder_auto_expand", "SELECT category, path FROM ax", PG, SINGLE)
_key = "array_to_string(list_transform(range(1, depth + 1), lambda i: (CASE WHEN i = depth AND is_file THEN 'f' ELSE 'd' END) || string_split(path, '/')[i]), chr(1))"
oracle(
    "tree_preorder",
    f"""SELECT row_number() OVER (ORDER BY CASE category WHEN 'Project' THEN 0 WHEN 'External' THEN 1 ELSE 2 END, {_key}) - 1 AS "row", category, path, is_file,
  lead(title) OVER (PARTITION BY category, parent ORDER BY is_file, title) IS NULL AS last FROM tn""",
    PG,
)
oracle(
    "tree_visible",
    """SELECT category, path FROM tn WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, depth)) AS i) u WHERE
  (category, array_to_string(string_split(tn.path, '/')[1:u.i], '/')) NOT IN (SELECT (category, path) FROM op))""",
    PG, SINGLE, "op AS (SELECT category, path FROM ax UNION SELECT category, path FROM tn WHERE depth = 1 AND NOT is_file)",
)
oracle("tree_roots", "SELECT category FROM pc UNION SELECT 'Project'", PG)
TR = f"""t0 AS (SELECT event_id AS id, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // 20 AS build, CASE WHEN event_id % 20 % 6 = 5 THEN event_id % 20 - 1 ELSE event_id % 20 END AS a0 FROM events),
t1 AS (SELECT *, CASE WHEN a0 > 0 THEN (a0 - 1) // 2 END AS a1 FROM t0), t2 AS (SELECT *, CASE WHEN a1 > 0 THEN (a1 - 1) // 2 END AS a2 FROM t1), t3 AS (SELECT *, CASE WHEN a2 > 0 THEN (a2 - 1) // 2 END AS a3 FROM t2),
t4 AS (SELECT *, list_filter([CASE WHEN a3 > 0 THEN (a3 - 1) // 2 END, a3, a2, a1, a0], lambda x: x IS NOT NULL) AS c FROM t3),
t5 AS (SELECT *, list_transform(c, lambda x: 1000 + (build * 20 + x) % 30000) AS p, list_transform(c, lambda x: build * 100 + x * 3) AS s FROM t4),
t6 AS (SELECT *, [1] || CASE WHEN k % 4 = 0 THEN p[1:len(p) - 1] || [70000 + id % 1000] || p[len(p):] ELSE p END AS ps, [0] || CASE WHEN k % 4 = 0 THEN s[1:len(s) - 1] || [build * 100 + 1] || s[len(s):] ELSE s END AS ss FROM t5),
tr AS (SELECT id + 1 AS line, CASE WHEN k % 43 <> 0 THEN '/b' || u % 5 END AS cwd,
  CASE WHEN k % 41 = 0 THEN [] WHEN k % 37 <> 0 THEN flatten(list_transform(range(1, len(ps) + 1), lambda i: [ps[i] - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END, ss[i] - CASE WHEN i > 1 THEN ss[i - 1] ELSE 0 END])) END::BIGINT[] AS pidlist,
  CASE WHEN k % 31 = 0 THEN [] WHEN k % 29 <> 0 THEN [['/usr/bin/g++', 'cc', 'make', 'clang++', 'cc1plus', 'gcc', 'ld', 'sh'][u % 8 + 1]] || CASE WHEN k % 3 = 0 THEN ['-include', 'pre' || u % 3 || '.h'] ELSE [] END
    || CASE WHEN k % 5 < 2 THEN ['-c'] WHEN k % 5 = 2 THEN ['-S'] WHEN k % 5 = 3 THEN ['-E', '-c'] ELSE ['-c', '-E'] END
    || CASE u % 4 WHEN 0 THEN ['-o', 'out/x' || k || '.o'] WHEN 1 THEN ['-o', 'y' || k || '.obj'] WHEN 2 THEN ['-o', 'z'] ELSE [] END
    || [CASE WHEN u % 3 = 1 THEN '/src/' ELSE '' END || ['a b.cc', 'it''s.cpp', 'x.c', 'start.S', 'no_source', '$v.cxx', 'pre.c++'][k % 7 + 1]] || CASE WHEN k % 17 = 0 THEN ['two.cc'] ELSE [] END || CASE WHEN k % 19 = 0 THEN ['-include'] ELSE [] END END::VARCHAR[] AS argv FROM t6),
td AS (SELECT line, i AS pos, CAST(list_sum(list_transform(range(0, i + 1), lambda k: pidlist[2 * k + 1])) AS BIGINT) AS pid, CAST(list_sum(list_transform(range(0, i + 1), lambda k: pidlist[2 * k + 2])) AS BIGINT) AS start, len(pidlist) // 2 AS n
  FROM (SELECT line, pidlist, unnest(range(0, len(pidlist) // 2)) AS i FROM tr)),
tp AS (SELECT a.line, b.line AS parent FROM td a JOIN td b ON a.pid = b.pid AND a.start = b.start AND b.pos = b.n - 1 AND a.pos < a.n - 1 AND b.line < a.line
  QUALIFY row_number() OVER (PARTITION BY a.line ORDER BY a.pos DESC, b.line DESC) = 1),
dr AS (SELECT line, list_contains([{', '.join(_text(x) for x in trace.DRIVERS)}], string_split(argv[1], '/')[-1]) AS d FROM tr),
up AS (SELECT line, parent FROM tp UNION SELECT up.line, tp.parent FROM up JOIN tp ON up.parent = tp.line),
bd AS (SELECT DISTINCT up.line FROM up JOIN dr ON up.parent = dr.line WHERE d)"""
oracle("trace_delta_decode", "SELECT line, pos, pid, start FROM td", TR)
oracle("trace_delta_encode", "SELECT line, unnest(range(0, len(pidlist))) AS pos, unnest(pidlist) AS delta FROM tr", TR)
oracle("trace_parent", "SELECT line, parent FROM tp", TR)
oracle("trace_driver_child", "SELECT line FROM bd", TR)
_safe = "^[^*?\\[\\]''\"\\\\$;&()|^<>\\s!#~`]+$"
STEPS = f"""st AS (SELECT line, cwd AS directory, argv, src[1] AS file FROM
(SELECT tr.*, list_filter(argv[2:], lambda a: NOT starts_with(a, '-') AND regexp_matches(a, '\\.(c|cc|cpp|cxx|c\\+\\+)$')) AS src, list_filter(argv[2:], lambda a: NOT starts_with(a, '-') AND regexp_matches(a, '\\.[sS]$')) AS asm,
  list_filter(argv, lambda a: a IN ('-c', '-S', '-E'))[-1] AS mode FROM tr JOIN dr USING (line) WHERE d AND line NOT IN (SELECT line FROM bd)) WHERE mode = '-c' AND len(src) = 1 AND len(asm) = 0)"""
oracle("trace_compile_steps", f"SELECT line, directory, array_to_string(list_transform(argv, lambda a: CASE WHEN regexp_matches(a, '{_safe}') THEN a ELSE chr(39) || replace(a, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) END), ' ') AS command, file FROM st", TR, STEPS)
JB = """jb AS (SELECT line, cwd AS directory, coalesce(argv[-1], 'e.c') AS file, argv FROM tr WHERE argv IS NOT NULL)"""
oracle(
    "compile_db_paths",
    """SELECT directory, source, CASE WHEN len(argv) = 0 THEN '' ELSE concat_ws(' ', CASE WHEN ends_with(argv[1], '++') THEN 'clang++' ELSE 'clang' END, CASE WHEN len(argv) > 1 THEN array_to_string(argv[2:], ' ') END) END AS argv,
  CASE WHEN starts_with(t, '/') THEN t ELSE coalesce(directory || '/', '') || t END AS index_path FROM
(SELECT *, coalesce(regexp_replace(o, '\\.[^.]*$', '.idx'), regexp_replace(string_split(source, '/')[-1], '\\.[^.]*$', '.idx')) AS t FROM
(SELECT directory, argv, CASE WHEN starts_with(file, '/') THEN file ELSE coalesce(directory || '/', '') || file END AS source,
  list_filter(list_transform(range(1, len(argv)), lambda i: CASE WHEN argv[i] = '-o' AND (ends_with(argv[i + 1], '.o') OR ends_with(argv[i + 1], '.obj')) THEN argv[i + 1] END), lambda x: x IS NOT NULL)[1] AS o FROM jb))""",
    TR, JB,
)
N0 = "n0 AS (SELECT event_id AS id, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '@/ev/' || strftime(ts, '%Y-%m-%d') AS file FROM events)"
FL = N0 + ", fl AS (SELECT DISTINCT CAST(k % 32 AS INTEGER) AS flags, u % 2 = 0 AS is_function, id % 3 = 0 AS is_rvalue FROM n0)"
oracle(
    "expr_ref_kinds",
    """SELECT *, 'Called' AS kind FROM fl WHERE flags & 1 <> 0 UNION ALL SELECT *, 'AddressTaken' FROM fl WHERE is_function AND (flags & 1 = 0 OR flags & 6 <> 0) OR NOT is_function AND flags & 4 <> 0
UNION ALL SELECT *, 'Read' FROM fl WHERE NOT is_function AND (flags & 2 <> 0 OR flags = 0 AND is_rvalue) UNION ALL SELECT *, 'Assigned' FROM fl WHERE NOT is_function AND flags & 8 <> 0
UNION ALL SELECT *, 'Modified' FROM fl WHERE NOT is_function AND flags & 16 <> 0 UNION ALL SELECT *, 'Other' FROM fl WHERE NOT is_function AND flags = 0 AND NOT is_rvalue""",
    FL,
)
oracle(
    "member_flags",
    """SELECT DISTINCT flags, is_function AS is_arrow, CAST(CASE WHEN is_function THEN 2 ELSE (flags & 4) + (CASE WHEN flags & 24 <> 0 THEN 16 ELSE 0 END) + (CASE WHEN flags & 3 <> 0 THEN 2 ELSE 0 END) END AS INTEGER) AS base,
  CAST(flags & 3 AS INTEGER) AS masked FROM fl""",
    FL,
)
# written down from the rules, one case each: what the part's use is
_PARTS = """call callee: 1 | call argument: 4 | comma left: 0 | comma right: whole | assign left: result + 8 | assign right: 0 | compound-assign left: result + 16 | compound-assign right: 0 | cast-array-to-pointer operand: 4 |
cast-to-void operand: 0 | cast-lvalue-to-rvalue operand: 2 | address-of operand: 4 | dereference operand: 0 | parenthesis operand: whole | declaration initialiser: 4 | return operand: 4 | list item: 4"""
_SPELLED = {"whole": "flags", "result": "(CASE WHEN flags & 1 <> 0 THEN (flags & 30) | 2 ELSE flags END)"}
oracle(
    "operand_flags",
    " UNION ALL ".join(
        f"SELECT '{name.split()[0]}' AS expression, '{name.split()[1]}' AS part, flags, CAST({' | '.join(_SPELLED.get(x.strip(), x) for x in use.split('+'))} AS INTEGER) AS part_flags FROM (SELECT DISTINCT flags FROM fl)"
        for name, use in (x.split(":") for x in _PARTS.split("|"))
    ),
    FL,
)
oracle("qualifier_segments", "SELECT symbol, i - 1 AS pos, q[i] AS qualifier FROM (SELECT symbol, q, unnest(range(1, len(q))) AS i FROM (SELECT DISTINCT symbol, string_split(symbol, '::') AS q FROM ev))", EV)
oracle(
    "symbol_names",
    """SELECT id, (CASE WHEN u % 3 = 0 THEN 'f.h@' || id || '/' WHEN u % 2 = 0 OR u % 4 = 0 AND k % 4 >= 2 THEN 'f.h/' ELSE '' END) || CASE WHEN k % 4 > 0 THEN 'n' || u || '::' ELSE '' END || CASE WHEN k % 4 > 1 THEN CASE WHEN u % 4 = 0 THEN '<anon>' ELSE 'mid' END || '::' ELSE '' END
  || CASE WHEN k % 4 > 2 THEN 's' || k || '::' ELSE '' END || CASE WHEN k % 8 <> 0 THEN 'f' || u ELSE '<unnamed' || id || '>' END
  || CASE WHEN k % 5 = 0 THEN '' ELSE '(' || ['', 'int', 'int, char *'][k % 3 + 1] || ')' || CASE WHEN k % 7 = 0 THEN ' const' ELSE '' END END AS symbol FROM n0""",
    N0,
)
oracle(
    "declaration_facts",
    """SELECT id, class, name, defining, symbol_type, kind FROM (SELECT *, CASE WHEN r.c IS NULL THEN 'Declaration' WHEN defining THEN dk ELSE ok END AS kind FROM d LEFT JOIN r ON d.class = r.c) WHERE kind IS NOT NULL AND name IS NOT NULL
UNION ALL SELECT id, class, target, defining, NULL, 'Namespace-Alias' FROM d WHERE class = 'namespace-alias' AND target IS NOT NULL""",
    N0, """r(c, dk, ok, symbol_type) AS (VALUES
  ('class', 'Definition', 'Declaration', 'Class'), ('class-template', NULL, NULL, NULL), ('constructor', 'Definition', 'Declaration', 'Constructor'), ('destructor', 'Definition', 'Declaration', 'Destructor'), ('enum', 'Definition', 'Declaration', 'Enum'), ('enumerator', 'Declaration', 'Declaration', 'Enumerator'),
  ('field', 'Declaration', 'Declaration', 'Field'), ('function', 'Definition', 'Declaration', 'Function'), ('function-template', NULL, NULL, NULL), ('global-variable', 'Definition', 'Declaration', 'GlobalVariable'), ('include', 'Included', 'Included', 'Path'), ('instantiated-function', NULL, NULL, NULL),
  ('interface', 'Definition', 'Declaration', 'Interface'), ('local-variable', 'Definition', 'Declaration', 'LocalVariable'), ('macro', 'Definition', 'Definition', 'Macro'), ('method', 'Definition', 'Declaration', 'Method'), ('namespace', 'Declaration', 'Declaration', 'Namespace'), ('namespace-alias', 'Declaration', 'Declaration', 'Namespace'),
  ('parameter', 'Definition', NULL, 'Parameter'), ('struct', 'Definition', 'Declaration', 'Struct'), ('typedef', 'Declaration', 'Declaration', 'Typedef'), ('union', 'Definition', 'Declaration', 'Union'), ('using-declaration', 'Using', 'Using', NULL), ('using-directive', 'Using-Directive', 'Using-Directive', NULL))""",
    """d AS (SELECT id, (SELECT list(c ORDER BY c) || ['label', NULL] FROM r)[(u * 7 + k) % 26 + 1] AS class, CASE WHEN k % 9 <> 0 THEN 'd' || u END AS name, CASE WHEN k % 4 <> 0 THEN 'N' || k END AS target, id % 2 = 0 AS defining FROM n0)""",
)
oracle("volume_definitions", "SELECT symbol, count(*) FILTER (kind = 'Definition') AS n_def, count(*) FILTER (kind = 'Declaration') AS n_decl FROM lr GROUP BY symbol", LI)
oracle(
    "volume_point_lookup",
    """SELECT p.file, p.line, p.col, lr.start_col, lr.end_col, lr.symbol, lr.kind FROM (SELECT DISTINCT file, line, start_col AS col FROM li) p JOIN lr ON p.file = lr.file AND p.line = lr.line AND lr.start_col <= p.col AND p.col < lr.end_col
  QUALIFY row_number() OVER (PARTITION BY p.file, p.line, p.col ORDER BY lr.start_col DESC, lr.end_col, lr.symbol, lr.kind) = 1""",
    LI,
)
oracle(
    "command_split",
    """SELECT line, array_to_string(a, '|') AS argv, CAST(len(a) AS BIGINT) AS n FROM
(SELECT line, CASE WHEN line % 3 <> 0 THEN argv WHEN len(argv) > 0 AND pidlist IS NOT NULL THEN [argv[1], '-DX="' || len(pidlist) || '"', ' it''s', 'z'] END AS a FROM tr WHERE argv IS NOT NULL)""",
    TR,
)
oracle(
    "widened_spans",
    """SELECT id, CAST(CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 4 WHEN 3 THEN 12 ELSE u % 7 + 1 END AS BIGINT) AS "start",
  CAST(CASE k % 5 WHEN 0 THEN 4 + n WHEN 1 THEN 18 WHEN 2 THEN 6 + n WHEN 3 THEN 12 + n ELSE u % 7 + 1 + n END AS BIGINT) AS "end" FROM (SELECT *, strlen('F' || u) AS n FROM n0)""",
    N0,
)
oracle("range_text", "SELECT file, string_agg(text, chr(10) ORDER BY line) AS text FROM dl WHERE line IN (1, 2) GROUP BY file", DOC)
oracle("char_widths", "SELECT file, line, n, is_word, count(*) AS chars, CAST(max(e - n) AS BIGINT) AS last FROM ch GROUP BY file, line, n, is_word", DOC, CHARS)
oracle("refs_with_text", "SELECT m.file, dl.line + 1 AS line, idx, text FROM m ASOF JOIN dl ON m.file = dl.file AND m.start >= dl.start", DOC, MATCH)
oracle("find_longest_matches", "SELECT file, idx, start, len FROM m", DOC, MATCH.replace("the[a-z]* of", "[a-z]+ of|the"))
oracle(
    "symbols_report_view",
    """v AS (SELECT symbol, symbol_type FROM ty WHERE regexp_matches(symbol, '(?i)k[1-3]$'))
SELECT row_number() OVER (ORDER BY symbol_type DESC NULLS LAST, symbol DESC) - 1 AS position, symbol, symbol_type, (SELECT greatest(coalesce(max(length(symbol)), 0), 6) FROM v) AS w_symbol, (SELECT greatest(coalesce(max(length(symbol_type)), 0), 11) FROM v) AS w_type FROM v""".replace("v AS (", ", v AS (", 1),
    EV, TYPED,
)
oracle(
    "references_at_span",
    """SELECT a.file AS at_file, a.line AS at_line, a.start_col AS at_start, a.end_col AS at_end, b.file, b.line, b.start_col, b.end_col, b.symbol, b.kind FROM
(SELECT DISTINCT r.file, r.line, r.start_col, r.end_col, r.symbol FROM r JOIN (SELECT DISTINCT file, line, start_col, end_col FROM r WHERE kind = 'Definition' AND file = (SELECT min(file) FROM ev)) USING (file, line, start_col, end_col)) a JOIN r b USING (symbol)""",
    EV,
)
oracle("index_project", f"SELECT {REF} FROM r WHERE line < 12 OR day(CAST(substr(file, 6) AS DATE)) > 20", EV)
oracle("type_facts", "SELECT id, 't' || u AS symbol, CASE WHEN u % 2 = 0 THEN 'Base-Class' ELSE 'Reference' END AS kind FROM n0 WHERE k % 6 < 4 AND u % 7 <> 0", N0)
oracle("initializer_facts", "SELECT id, 'C' || u || '::m' || k AS symbol, 'Initialized' AS kind FROM n0 WHERE k % 5 <> 0", N0)
oracle("include_facts", "SELECT file, id AS line, k + 1 AS start_col, k + 9 AS end_col, '@' || CASE WHEN k % 6 < 2 THEN '<blank>' ELSE '/i/h' || u || '.h' END AS symbol, 'Included' AS kind, 'Path' AS symbol_type FROM n0 WHERE k % 4 <> 0", N0)
oracle(
    "scoped_names",
    """SELECT id, CASE WHEN k % 4 > 0 THEN 'n' || u || '::' ELSE '' END || CASE WHEN k % 4 > 1 AND u % 2 = 1 THEN 'Colour::' ELSE '' END || CASE WHEN k % 4 > 2 THEN CASE WHEN u % 3 = 0 THEN '<anon>' ELSE 'in' END || '::' ELSE '' END
  || CASE WHEN k % 5 <> 0 THEN 'f' || u WHEN k % 10 = 0 THEN 'T' ELSE '<unnamed' || id || '>' END || CASE WHEN k % 6 = 0 THEN '<int, A' || k || '>' ELSE '' END
  || CASE WHEN k % 3 = 0 THEN '' ELSE '(' || ['', 'int', 'int, T &'][u % 3 + 1] || ')' || CASE WHEN k % 7 = 0 THEN ' const' ELSE '' END END AS symbol FROM n0""",
    N0,
)
oracle("trace_to_compile_db", "SELECT directory, file, array_to_string(argv, '|') AS argv FROM st", TR, STEPS)
oracle(
    "pch_strip",
    """SELECT line, directory, array_to_string(CASE WHEN argv[2] = '-include' AND coalesce(directory || '/', '') || argv[3] IN (SELECT path FROM ph) THEN [argv[1]] || argv[4:] ELSE argv END, ' ') AS argv FROM jb""",
    TR, JB, "ph AS (SELECT DISTINCT '/b' || user_id % 5 || '/pre' || user_id % 3 || '.h' AS path FROM events WHERE user_id % 11 <> 0 AND user_id % 5 IN (0, 2) AND user_id % 3 = 1)",
)
oracle("trace_stream_parents", "SELECT tr.line, tp.parent, coalesce(dr.d, false) AS driver, bd.line IS NOT NULL AS below FROM tr LEFT JOIN tp USING (line) LEFT JOIN dr USING (line) LEFT JOIN bd USING (line)", TR)
oracle(
    "match_backgrounds",
    """SELECT file, what, count(*) AS n, min("at") AS first FROM (SELECT file, "at", arg_max(what, p) AS what FROM (SELECT file, what, CASE what WHEN 'selection' THEN 3 WHEN 'hover' THEN 2 ELSE 1 END AS p, unnest(range(a, b)) AS "at" FROM
(SELECT file, start AS a, start + len AS b, CASE idx WHEN 1 THEN 'hover' WHEN 2 THEN 'selection' ELSE 'match' END AS what FROM m UNION ALL SELECT file, greatest(start - 40, 0), start + len, 'selection' FROM m WHERE idx = 2)) GROUP BY file, "at") GROUP BY file, what""",
    DOC, MATCH,
)
oracle("tree_open_all", "SELECT DISTINCT category, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM (SELECT category, path, unnest(range(1, depth)) AS i FROM tn WHERE is_file AND depth > 2)", PG)
oracle("archive_entry_position", "SELECT CASE WHEN count(*) FILTER (file = n) > 0 THEN count(DISTINCT file) FILTER (file < n) ELSE -1 END AS position FROM ev, (VALUES ('@/ev/2024-01-05'), ('@/zz')) AS v(n) GROUP BY n", EV)
oracle("archive_dump", "SELECT name, hash, n, symbols FROM he JOIN (SELECT file AS name, count(DISTINCT symbol) AS symbols FROM r GROUP BY file) USING (name)", EV, HASHES)
oracle("report_batches", "SELECT CAST(i // greatest(100, t // 20) AS BIGINT) AS batch, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS i, count(*) OVER () AS t FROM (SELECT symbol FROM ev UNION SELECT file FROM ev)) GROUP BY 1", EV)
oracle("canonical_files", "SELECT sha256(content) AS real_path, doc_id AS id, min(doc_id) OVER (PARTITION BY content) AS canonical FROM df", DOC)
oracle(
    "macro_facts",
    """SELECT strftime(ts, '%Y-%m-%d') AS file, hour(ts) AS line, minute(ts) AS start_col, minute(ts) + strlen('M' || user_id) AS end_col, '#M' || user_id AS symbol,
  CASE event_type WHEN 'signup' THEN 'Definition' WHEN 'purchase' THEN 'Undefinition' WHEN 'click' THEN 'Expansion' ELSE 'Defined-Test' END AS kind, 'Macro' AS symbol_type FROM events""",
)


def _recorded(source: str, place: str) -> str:
    """Rows of source with place recorded in the list es (from 1) at the cursor cu (from 0, -1 for none)."""
    fresh = f"SELECT *, CASE WHEN {place} IS NULL OR cu >= 0 AND es[cu + 1] = {place} THEN 0 WHEN cu >= 0 AND cu < len(es) - 1 AND es[cu + 2] = {place} THEN 1 ELSE 2 END AS how FROM ({source})"
    put = f"SELECT * REPLACE (CASE WHEN how = 2 THEN es[1:cu + 1] || [{place}] || es[cu + 2:] ELSE es END AS es, CASE WHEN how = 0 THEN cu ELSE cu + 1 END AS cu) FROM ({fresh})"
    return f"SELECT * EXCLUDE (how) REPLACE (CASE WHEN how = 2 THEN es[greatest(0, cu - 100) + 1:cu + 101] ELSE es END AS es, CASE WHEN how = 2 THEN cu - greatest(0, cu - 100) ELSE cu END AS cu) FROM ({put})"


_next = "SELECT h.session, e.i, e.seq, e.action, e.place, e.origin, h.es, h.cu FROM h JOIN he0 e ON e.session = h.session AND e.i = h.i + 1"
_jumps = _recorded(_recorded(f"SELECT * FROM ({_next}) WHERE action = 'jump'", "origin"), "place")
_steps = f"""SELECT *, CASE WHEN cu + k >= 0 AND cu + k < len(es) THEN cu + k END AS nc FROM (SELECT *, CASE action WHEN 'back' THEN -1 ELSE 1 END AS k FROM ({_next}) WHERE action <> 'jump')"""
oracle(
    "history_fold",
    'SELECT session, seq, action, "at", CAST(cu AS BIGINT) AS "cursor", CAST(len(es) AS BIGINT) AS size FROM h WHERE i > 0',
    """he0 AS (SELECT 's' || user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 'back' WHEN 'signup' THEN 'forward' ELSE 'jump' END AS action, json_extract_string(props, '$.k') AS place,
  CASE WHEN event_type = 'click' THEN 'o' || json_extract_string(props, '$.k') END AS origin, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)""",
    f"""h AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST([] AS VARCHAR[]) AS es, CAST(-1 AS BIGINT) AS cu, CAST(NULL AS VARCHAR) AS "at" FROM he0 UNION ALL
SELECT session, i, seq, action, es, cu, "at" FROM (SELECT session, i, seq, action, es, cu, place AS "at" FROM ({_jumps}) UNION ALL
SELECT session, i, seq, action, CASE WHEN nc IS NULL THEN es ELSE es[greatest(0, nc - 100) + 1:nc + 101] END, CASE WHEN nc IS NULL THEN cu ELSE nc - greatest(0, nc - 100) END, CASE WHEN nc IS NOT NULL THEN es[nc + 1] END FROM ({_steps})))""",
)


# tokens by one pattern: a line feed is put before the text, and directives take the one before them, so a line's beginning is part of the pattern
_TOKENS = r"""\n[ \t]*#[ \t]*(?:include_next|include|import)[ \t]*<(?:\\(?s:.)|[^\\>])*(?:>|\\?\z)|\n[ \t]*#[ \t]*[A-Za-z_]*|/\*(?s:.*?)(?:\*/|\z)|//(?:\\\n|[^\n])*|'(?:\\(?s:.)|[^\\'])*(?:'|\\?\z)|"(?:\\(?s:.)|[^\\"])*(?:"|\\?\z)|\.?[0-9](?:[eE][+-]|[A-Za-z0-9_.])*|[A-Za-z_][A-Za-z0-9_]*|(?s:.)""".replace("'", "''")


def lexed(files: str) -> str:
    """CTEs that end in sk (file, start, "end", kind) of a table with file and content."""
    words = lambda xs: ", ".join(map(_text, sorted(xs)))
    return f"""sx0 AS (SELECT file, regexp_extract_all(chr(10) || content, '{_TOKENS}') AS ts FROM {files} WHERE content <> ''),
sx1 AS (SELECT file, ts[i] AS t, i, i > 1 AND starts_with(ts[i - 1], '//') AS after_comment FROM (SELECT file, ts, unnest(range(1, len(ts) + 1)) AS i FROM sx0)),
sx2 AS (SELECT file, i, t, CASE WHEN after_comment THEN 'comment' ELSE 'default' END AS feed, regexp_matches(t, '^\\n[ \\t]*#') AS hash, regexp_extract(t, '#[ \\t]*([A-Za-z_]*)', 1) AS name, regexp_extract(t, '^\\n([ \\t]*)#', 1) AS blanks,
  regexp_extract(t, '^\\n[ \\t]*(#[ \\t]*[A-Za-z_]*)', 1) AS word, regexp_extract(t, '^\\n[ \\t]*#[ \\t]*[A-Za-z_]*([ \\t]*)', 1) AS gap FROM sx1),
sx3 AS (SELECT file, i, unnest(CASE WHEN hash THEN [{{n: 1, k: feed}}, {{n: strlen(blanks), k: 'default'}}, {{n: strlen(word), k: CASE WHEN name IN ({words(syntax.DIRECTIVES)}) THEN 'directive' ELSE 'default' END}},
    {{n: strlen(gap), k: 'default'}}, {{n: strlen(t) - 1 - strlen(blanks) - strlen(word) - strlen(gap), k: 'quoted'}}]
  ELSE [{{n: strlen(t), k: CASE WHEN t = chr(10) THEN feed WHEN t LIKE '/*%' OR t LIKE '//%' THEN 'comment' WHEN starts_with(t, chr(39)) OR starts_with(t, chr(34)) THEN 'quoted' WHEN regexp_matches(t, '^\\.?[0-9]') THEN 'number'
    WHEN t IN ({words(syntax.KEYWORDS)}) THEN 'keyword' ELSE 'default' END}}] END) AS x, unnest(CASE WHEN hash THEN [1, 2, 3, 4, 5] ELSE [1] END) AS j FROM sx2),
sx4 AS (SELECT file, i, j, x.k AS kind, x.n AS n, sum(x.n) OVER (PARTITION BY file ORDER BY i, j) - 1 AS e FROM sx3 WHERE x.n > 0),
sx5 AS (SELECT file, greatest(e - n, 0) AS s, e, kind FROM sx4 WHERE e > 0),
sx6 AS (SELECT *, sum(CASE WHEN kind = before THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s) AS island FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY file ORDER BY s), '') AS before FROM sx5)),
sk AS (SELECT file, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", any_value(kind) AS kind FROM sx6 GROUP BY file, island)"""


oracle("syntax_kinds", 'SELECT file, start, "end", kind FROM sk', DOC, lexed("df"))
_MADE = ["#if X", " # define Y 1", "#include <a b.h>", "x #if 2", "#pragma once", "#nothing here", "// note \\", "/* open", "closed */ #else", "'c' \"s\" 1.5e+3", "#include_next \t<x", "int y; // #endif", "#  import <z>"]
oracle("directive_kinds", 'SELECT file, start, "end", kind FROM sk', N0, f"mf AS (SELECT CAST(id // 50 AS VARCHAR) AS file, string_agg({_text(_MADE)}[(k + u) % {len(_MADE)} + 1], chr(10) ORDER BY id) AS content FROM n0 GROUP BY id // 50)", lexed("mf"))
oracle("syntax_pieces", 'SELECT file, start, "end", kind FROM sk', "lf AS (SELECT lang || '/' || doc_id // 20 AS file, string_agg(text, chr(10) ORDER BY doc_id, text) AS content FROM documents WHERE text IS NOT NULL GROUP BY lang, doc_id // 20)", lexed("lf"))
_kind_colour = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in syntax.KIND_COLOURS.items()) + " ELSE 'default' END"
oracle(
    "file_colours",
    'SELECT file, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", any_value(colour) AS colour FROM island GROUP BY file, i',
    DOC, MATCH, lexed("df"),
    f"""cs AS (SELECT file, start AS s, start + len AS e, idx, CASE idx % 3 WHEN 0 THEN 'darkMagenta' WHEN 1 THEN 'darkBlue' END AS colour FROM m WHERE idx % 3 < 2),
cut AS (SELECT file, start AS s FROM sk UNION SELECT file, "end" FROM sk UNION SELECT file, s FROM cs UNION SELECT file, e FROM cs),
seg AS (SELECT * FROM (SELECT file, s, lead(s) OVER (PARTITION BY file ORDER BY s) AS e FROM cut) WHERE e IS NOT NULL),
top AS (SELECT seg.file, seg.s, max(idx) AS idx FROM seg JOIN cs ON seg.file = cs.file AND cs.s <= seg.s AND seg.s < cs.e GROUP BY seg.file, seg.s),
col AS (SELECT k.file, k.s, k.e, coalesce(cs.colour, {_kind_colour}) AS colour FROM (SELECT seg.*, sk.kind FROM seg ASOF JOIN sk ON seg.file = sk.file AND seg.s >= sk.start) k LEFT JOIN top ON top.file = k.file AND top.s = k.s LEFT JOIN cs ON cs.file = top.file AND cs.idx = top.idx),
island AS (SELECT *, sum(CASE WHEN colour = before THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s) AS i FROM (SELECT *, coalesce(lag(colour) OVER (PARTITION BY file ORDER BY s), '') AS before FROM col))""",
)
oracle(
    "colour_runs",
    f"""SELECT file, line, CAST(min(col) AS BIGINT) AS start, CAST(max(col) + 1 AS BIGINT) AS "end", any_value(colour) AS colour FROM (SELECT *, col - row_number() OVER (PARTITION BY file, line, colour ORDER BY col) AS g FROM
(SELECT file, line, col, c.colour AS colour FROM (SELECT file, line, col, max({{a: start_col, b: end_col, c: symbol, d: kind, colour: colour}}) AS c FROM
(SELECT DISTINCT file, line, start_col, end_col, symbol, kind, {_colour} AS colour, unnest(range(start_col, end_col)) AS col FROM ev) WHERE colour IS NOT NULL GROUP BY file, line, col))) GROUP BY file, line, colour, g""",
    EV,
)
