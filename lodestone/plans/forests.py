"""Registered queries over expression trees and declaration forests, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import expressions, naming
from lodestone.plans.oracle import oracle
from lodestone.sources.facts import declaration_forest, expression_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def expression_kinds(s: SparkSession, d: str) -> DataFrame:
    """Kinds of the references that every leaf of the trees makes, by its use in the whole."""
    return expressions.leaf_references(expression_nodes(s, d))


@query
def expression_flags(s: SparkSession, d: str) -> DataFrame:
    return expressions.context_flags(expression_nodes(s, d)).select("node", "flags")


@query
def declared_names(s: SparkSession, d: str) -> DataFrame:
    return naming.symbol_names(declaration_forest(s, d))


@query
def specialised_arguments(s: SparkSession, d: str) -> DataFrame:
    return naming.specialisation_arguments(declaration_forest(s, d)).select("decl", F.array_join("arguments", ", ").alias("arguments"))


NODES = """n0 AS (SELECT event_id AS id, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events),
nd AS (SELECT id AS node, CASE WHEN id % 400 > 0 THEN id - 1 - k % least(id % 400, 3) END AS parent, least((u + k) % 30, 21) AS r, k % 11 <> 0 AS ex, event_type IN ('click', 'error') AS rv, CASE WHEN id % 3 = 0 THEN u % 4 = 0 END AS fn FROM n0)"""
# by the number of the rule: what comes down to the part from f, the use of the whole (1 called, 2 read, 4 address, 8 assigned, 16 modified)
_DOWN = """CASE r WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 3 THEN f WHEN 4 THEN (CASE WHEN f & 1 <> 0 THEN (f & 30) | 2 ELSE f END) | 8 WHEN 5 THEN 0 WHEN 6 THEN (CASE WHEN f & 1 <> 0 THEN (f & 30) | 2 ELSE f END) | 16
  WHEN 7 THEN 0 WHEN 8 THEN 4 WHEN 9 THEN 0 WHEN 10 THEN 2 WHEN 11 THEN 4 WHEN 12 THEN 0 WHEN 13 THEN f WHEN 14 THEN 4 WHEN 15 THEN 4 WHEN 16 THEN 4 WHEN 17 THEN 2 WHEN 21 THEN f
  ELSE (f & 4) | (CASE WHEN f & 24 <> 0 THEN 16 ELSE 0 END) | (CASE WHEN f & 3 <> 0 THEN 2 ELSE 0 END) END"""
FLAGS = f"""fg AS (SELECT node, CAST(CASE WHEN NOT ex THEN 0 WHEN rv THEN g & 3 ELSE g END AS INTEGER) AS flags FROM (SELECT node, ex, rv, {_DOWN} AS g FROM (SELECT *, 0 AS f FROM nd WHERE parent IS NULL)) UNION ALL
  SELECT node, CAST(CASE WHEN NOT ex THEN 0 WHEN rv THEN g & 3 ELSE g END AS INTEGER) FROM (SELECT node, ex, rv, {_DOWN} AS g FROM (SELECT nd.*, fg.flags AS f FROM nd JOIN fg ON nd.parent = fg.node)))"""
oracle("expression_flags", "SELECT node, flags FROM fg", NODES, FLAGS)
oracle(
    "expression_kinds",
    """SELECT node, flags, 'Called' AS kind FROM fl WHERE flags & 1 <> 0 UNION ALL SELECT node, flags, 'AddressTaken' FROM fl WHERE fn AND (flags & 1 = 0 OR flags & 6 <> 0) OR NOT fn AND flags & 4 <> 0
UNION ALL SELECT node, flags, 'Read' FROM fl WHERE NOT fn AND (flags & 2 <> 0 OR flags = 0 AND rv) UNION ALL SELECT node, flags, 'Assigned' FROM fl WHERE NOT fn AND flags & 8 <> 0
UNION ALL SELECT node, flags, 'Modified' FROM fl WHERE NOT fn AND flags & 16 <> 0 UNION ALL SELECT node, flags, 'Other' FROM fl WHERE NOT fn AND flags = 0 AND NOT rv""",
    NODES, FLAGS, "fl AS (SELECT * FROM nd JOIN fg USING (node) WHERE fn IS NOT NULL)",
)

FOREST = """n0 AS (SELECT event_id AS id, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day, event_id % 12 AS t, event_id % 60 AS m FROM events),
d AS (SELECT id AS decl, CASE WHEN m > 0 THEN id - 1 - k % least(m, 4) END AS parent,
  CASE t WHEN 0 THEN 'namespace' WHEN 1 THEN 'namespace' WHEN 2 THEN 'tag' WHEN 3 THEN 'tag' WHEN 4 THEN 'enum' WHEN 5 THEN 'function' WHEN 6 THEN 'function' WHEN 7 THEN 'variable' WHEN 8 THEN 'class-specialisation' WHEN 9 THEN 'enumerator'
    WHEN 10 THEN 'field' ELSE CASE WHEN u % 3 <> 0 THEN 'typedef' ELSE 'linkage' END END AS class,
  CASE WHEN t = 11 AND u % 3 <> 0 THEN 't' || u WHEN t IN (1, 3, 11) OR t = 10 AND u % 5 = 0 THEN NULL ELSE 'n' || u END AS name, CASE WHEN t = 3 AND u % 2 = 0 THEN 'T' || k END AS typedef_name,
  CASE WHEN k % 13 <> 0 THEN 'f' || u % 7 || '.h' END AS base, id * 10 AS place, CASE WHEN u % 6 <> 0 THEN id - id % 5 END AS canonical, k % 7 = 0 AS extern_c, k % 5 = 0 AS outside, k % 2 = 0 AS defining, k % 3 = 0 AS explicit,
  CASE WHEN t IN (5, 6, 8) AND k % 4 <> 1 AND m >= 12 THEN id - 12 END AS origin, CASE WHEN t = 8 OR k % 5 = 1 THEN CASE WHEN k % 2 = 0 THEN 'int, A' || k ELSE 'B' || u END END AS args,
  array_to_string((['int', 'char *', 'T &'])[1:k % 4], ', ') AS params, CASE WHEN k % 4 = 0 THEN ' const' ELSE '' END AS quals FROM n0)"""
SPECIAL = """sq AS (SELECT decl, decl AS cur FROM d WHERE class = 'class-specialisation' UNION ALL SELECT sq.decl, o.decl FROM sq JOIN d ON d.decl = sq.cur JOIN d o ON o.decl = d.origin AND o.class = 'class-specialisation' WHERE NOT d.explicit),
sa AS (SELECT sq.decl, d.args FROM sq JOIN d ON d.decl = sq.cur WHERE d.explicit)"""
oracle("specialised_arguments", "SELECT d.decl, sa.args AS arguments FROM d LEFT JOIN sa USING (decl) WHERE class = 'class-specialisation'", FOREST, SPECIAL)
oracle(
    "declared_names",
    """SELECT decl, CASE WHEN a = 0 OR base IS NULL THEN '' WHEN a >= 2 THEN base || '@' || place || '/' ELSE base || '/' END || coalesce(outer_text || '::', '') || own AS symbol FROM
(SELECT g.decl, g.own, g.asks | coalesce(w.asked, 0) AS a, w.text AS outer_text, CASE WHEN c.decl IS NULL THEN d.base ELSE c.base END AS base, CASE WHEN c.decl IS NULL THEN d.place ELSE c.place END AS place
 FROM g JOIN d ON g.decl = d.decl LEFT JOIN d c ON c.decl = d.canonical LEFT JOIN w ON w.decl = g.scope WHERE g.own IS NOT NULL AND g.class <> 'linkage')""",
    FOREST, SPECIAL,
    """e AS (SELECT d.decl, d.class, d.typedef_name, d.place, d.extern_c, coalesce(c.extern_c, d.extern_c) AS first_c, q.parent, q.name, q.args, q.params, q.quals, q.outside, q.defining FROM d LEFT JOIN d p ON d.class = 'function' AND p.class = 'function' AND p.decl = d.origin
  LEFT JOIN d c ON c.decl = d.canonical JOIN d q ON q.decl = coalesce(p.decl, d.decl)),
g AS (SELECT e.decl, class, parent AS scope, CASE class WHEN 'namespace' THEN coalesce(name, '<anon>') WHEN 'class-specialisation' THEN coalesce(typedef_name, name, '<unnamed' || place || '>') || coalesce('<' || sa.args || '>', '')
    WHEN 'tag' THEN coalesce(typedef_name, name, '<unnamed' || place || '>') WHEN 'enum' THEN coalesce(typedef_name, name, '<unnamed' || place || '>')
    WHEN 'function' THEN name || coalesce('<' || e.args || '>', '') || CASE WHEN first_c THEN '' ELSE '(' || params || ')' || quals END ELSE name END AS own,
  CASE WHEN class = 'namespace' AND name IS NULL OR class = 'variable' AND NOT extern_c AND NOT outside OR class = 'function' AND NOT first_c AND NOT outside THEN 1 ELSE 0 END AS asks, CASE WHEN class = 'function' AND defining THEN 3 ELSE 0 END AS body
  FROM e LEFT JOIN sa USING (decl)),
w AS (SELECT decl, CASE WHEN class <> 'enum' THEN own END AS text, asks | body AS asked FROM g WHERE class <> 'linkage' AND (scope IS NULL OR scope NOT IN (SELECT decl FROM g WHERE class <> 'linkage')) UNION ALL
  SELECT g.decl, CASE WHEN class = 'enum' OR own IS NULL THEN w.text WHEN w.text IS NULL THEN own ELSE w.text || '::' || own END, asks | body | w.asked FROM g JOIN w ON g.scope = w.decl WHERE class <> 'linkage')""",
)
