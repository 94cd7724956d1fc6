"""All registered queries of the change-history library."""

from __future__ import annotations

from . import assembly, audits, features, graph, history, history_graph, metrics, ownership, runs, splits, statistics
from .common import Query

_MODULES = [ownership, statistics, splits, audits, metrics, graph, assembly, history, history_graph, features, runs]


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
