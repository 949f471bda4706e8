"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from clausegrid.plans import queries_audit, queries_corpus, queries_evidence, queries_metrics, queries_retrieval, queries_text

MODULES = [queries_text, queries_retrieval, queries_evidence, queries_metrics, queries_corpus, queries_audit]


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
