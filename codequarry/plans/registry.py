"""All queries by name. Those of the optional subpackage are added by the entry module."""

from __future__ import annotations

from codequarry.plans import core_queries, data_queries, fixture_queries, index_queries, source_queries

MODULES = [core_queries, source_queries, fixture_queries, index_queries, data_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
