"""The operators that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from dialmill.llm import queries


def value(v):
    return "NULL" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df, want = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = want.select(*df.columns).fetchall()
    assert sorted(tuple(map(value, r)) for r in df.collect()) == sorted(tuple(map(value, r)) for r in rows)
