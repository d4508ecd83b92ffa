"""Named queries over the test tables and their DuckDB twins."""

from __future__ import annotations

from notegraph.plans import base, graph, loop, search
from notegraph.shipping import shipping

_MODULES = (base, graph, search, loop)


def queries() -> dict:
    return {k: shipping(v) for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
