"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(_plain(v) for v in r) for r in cur.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == want
