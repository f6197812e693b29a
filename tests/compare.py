"""Compare a query with its SQL, as sets of rows with floats rounded."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def compare(frame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.sql(sql)
    columns, rows = found.columns, found.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    at = [columns.index(c) for c in frame.columns]
    expected = sorted(repr([plain(r[i]) for i in at]) for r in rows)
    assert sorted(repr([plain(x) for x in r]) for r in frame.collect()) == expected
