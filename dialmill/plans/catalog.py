"""Query catalog: name -> builder, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from dialmill.plans import queries_data, queries_more, queries_pairs, queries_score


def queries() -> dict[str, Callable]:
    return {n: q for m in (queries_score, queries_data, queries_pairs, queries_more) for n, (q, _) in m.CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in (queries_score, queries_data, queries_pairs, queries_more) for n, (_, s) in m.CATALOG.items() if s}
