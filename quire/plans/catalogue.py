"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from quire.plans import prompt_queries, registry, state_queries, term_queries, text_queries  # noqa: F401 - importing registers the queries


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
