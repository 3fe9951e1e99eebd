"""All queries of the core."""

from __future__ import annotations

from pagewright.plans import exports, nested, pages, reports

_MODULES = (exports, nested, pages, reports)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
