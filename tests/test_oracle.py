"""Every query of the rule engine against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from dialmill.plans import catalog, derive

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.fixture(scope="session", autouse=True)
def scores_once():
    """The scored answers, which most queries start from, are computed once for this session."""
    whole, seen = derive.narrow, {}

    def once(spark, sf_dir):
        if sf_dir not in seen:
            seen[sf_dir] = whole(spark, sf_dir)
        return seen[sf_dir]

    derive.narrow = once
    yield
    derive.narrow = whole


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


ODD = {  # documents, benchmark
    "repeated documents": ("SELECT CASE WHEN doc_id < 40 THEN 62 WHEN doc_id < 60 THEN 31 ELSE doc_id // (1 + k) END AS doc_id, text, lang FROM d, range(2) t(k)", "FROM b"),
    "repeated items": ("FROM d", "SELECT b.* FROM b, range(2)"),
    "negative ids": ("SELECT doc_id - 100 AS doc_id, text, lang FROM d", "FROM b"),
    "blank texts": ("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN ' ' END AS text, lang FROM d", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN repeat('x', 700) END AS text FROM b"),
    "item without an id": ("FROM d", "SELECT nullif(item_id, 8) AS item_id, text FROM b"),
}


@pytest.mark.parametrize("name", ODD)
def test_record_errors_match_sql_on_odd_tables(spark, sf, tmp_path, name):
    c = duckdb.connect()
    for t, view, query in zip(("documents", "benchmark"), "db", ODD[name], strict=True):
        c.sql(f"CREATE VIEW {view} AS FROM '{sf}/{t}.parquet'")
        c.sql(f"COPY ({query}) TO '{tmp_path}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    for query in ("record_error_counts", "validate_records", "record_totals"):
        df = catalog.queries()[query](spark, str(tmp_path))
        want = c.sql(catalog.oracle_sql()[query])
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
