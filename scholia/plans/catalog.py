"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from scholia.plans import aggregates_q, analysis_q, datacare, files_q, hybrid_q, joins_q, more_q, records_q, review_q, search_q, streams_q, windows_q

MODULES = (datacare, records_q, joins_q, aggregates_q, windows_q, search_q, hybrid_q, streams_q, more_q, analysis_q, files_q, review_q)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
