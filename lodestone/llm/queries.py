"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import hnsw, htmltext, lbl, linefreq, mixing, neardup, packing, partial, pseudonyms, secrets, simhash, toxicity, whiten
from lodestone.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op1_toxicity"] = op1_toxicity


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two turns by their id; what the first turn scanned stands in the ledger for the second."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.scan_in_turn(docs.select("doc_id", "text"), F.pmod(F.hash("doc_id"), F.lit(2)))
    return secrets.digest(docs, ledger)


QUERIES["op10_secrets"] = op10_secrets
_ANY_CASE = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"


def _secrets_sql() -> str:
    """Spans by the lengths of the gaps and matches before them."""
    parts = []
    for place, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", _ANY_CASE).replace("'", "''")
        whole = f"{pattern}" if not r.group else pattern
        least = f"length(regexp_extract(ms[i], '{whole}', {r.group})) >= {r.least}" if r.least else "true"
        parts.append(
            f"""SELECT doc_id, {place} AS rule, '{r.name}' AS kind,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS s,
  CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda m: length(m))) AS BIGINT) AS e
FROM (SELECT doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) AS i FROM
  (SELECT doc_id, string_split_regex(t, '{whole}') AS gaps, regexp_extract_all(t, '{whole}') AS ms FROM d)) WHERE {least}"""
        )
    base = ", ".join(f"'{r.name}'" for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) FILTER (kind IN ({base})), '')) AS base_sha256,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL["op10_secrets"] = _secrets_sql()


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key=spark.conf.get("lodestone.pseudonym.key", "lodestone-demonstration-key"))


QUERIES["op2_pseudonyms"] = op2_pseudonyms


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.line_quality(table(spark, sf_dir, "documents"))


QUERIES["op3_line_quality"] = op3_line_quality
_SPACE = "[\\x20\\x09-\\x0D]+"
ORACLE_SQL["op3_line_quality"] = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
l AS (SELECT rid, source, (doc_id, CASE WHEN doc_id IS NULL THEN rid END) AS doc, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, source, doc, line, trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g'), ' ') AS n FROM l),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE n <> '' GROUP BY rid),
h AS (SELECT source, count(DISTINCT (doc_id, CASE WHEN doc_id IS NULL THEN rid END)) AS host_docs FROM d GROUP BY source),
bad AS (SELECT c.source, n FROM (SELECT source, n, count(DISTINCT doc) AS k FROM ln WHERE n <> '' GROUP BY source, n) c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE k >= 10 AND k > 0.02 * host_docs),
rm AS (SELECT rid, sum(len(ln.n) - len(replace(ln.n, ' ', '')) + 1) AS n FROM ln JOIN bad ON ln.source IS NOT DISTINCT FROM bad.source AND ln.n = bad.n GROUP BY rid),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(rm.n, 0) AS BIGINT) AS n_removed
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN rm USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed >= 0.5 * n_words AS kept FROM o"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES["op7_mixing"] = op7_mixing


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES["op4_packing"] = op4_packing


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op8_near_duplicates"] = op8_near_duplicates


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES["op6_nearest"] = op6_nearest


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.lm_scores(table(spark, sf_dir, "documents"))


QUERIES["op5_lm_scores"] = op5_lm_scores


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES["op9_main_text"] = op9_main_text


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial.codes(table(spark, sf_dir, "embeddings"))


QUERIES["op11_codes"] = op11_codes


def _codes_sql() -> str:
    """Distances are |x|^2 - 2 x.c + |c|^2 in doubles, exact for these integers; each round is two tables."""
    vectors = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor({partial.SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT rid, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM k, (SELECT unnest(range(0, {partial.PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (rid) WHERE e < {partial.ENTRIES})"""
    near = """a{i} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, CAST(min(d) AS BIGINT) AS d FROM
  (SELECT rid, v.p, e, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x) AS d
   FROM (SELECT rid, p, CAST(x AS DOUBLE[]) AS x FROM v) v JOIN (SELECT p, e, CAST(x AS DOUBLE[]) AS x FROM b{i}) b USING (p)) GROUP BY rid, p)"""
    move = """b{j} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN
  (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS x FROM
    (SELECT p, e, pos, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT v.p, a.e, unnest(v.x) AS c, unnest(range(len(v.x))) AS pos FROM v JOIN a{i} a USING (rid, p)) GROUP BY p, e, pos) GROUP BY p, e) m
  USING (p, e))"""
    rounds = [near.format(i=i) + ",\n" + move.format(i=i, j=i + 1) for i in range(partial.ROUNDS)] + [near.format(i=partial.ROUNDS)]
    return ",\n".join([vectors, *rounds]) + f""",
o AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{partial.ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{partial.ROUNDS}) AS codebooks_sha256 FROM o JOIN k USING (rid)"""


ORACLE_SQL["op11_codes"] = _codes_sql()


def op12_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


QUERIES["op12_whitened"] = op12_whitened


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


QUERIES["op13_simhash"] = op13_simhash
