"""All queries of the core, with their SQL."""

from __future__ import annotations

from quire.plans import attribution_queries, case_queries, catalog_queries, entity_queries, history_queries, job_queries, text_queries

_MODULES = [history_queries, catalog_queries, text_queries, entity_queries, attribution_queries, job_queries, case_queries]
FLAGSHIP = text_queries.boilerplate_phrases


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
