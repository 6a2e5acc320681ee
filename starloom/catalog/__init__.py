"""Registered queries and their DuckDB SQL, by topic."""

from __future__ import annotations

import importlib

TOPICS = ("builder", "dimensions", "temporal", "hierarchy", "graph", "questions", "gold", "analysis")


def _modules():
    return [importlib.import_module(f"{__name__}.{t}") for t in TOPICS]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
