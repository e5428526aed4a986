"""Queries of the llm operators, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib

_NAMES = ["component_queries", "splitting_queries", "truncation_queries", "packing_queries", "mixing_queries", "lookalike_queries", "sentence_queries", "name_queries"]
_MODULES = [importlib.import_module(f"quire.llm.{name}") for name in _NAMES]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
