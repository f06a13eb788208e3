"""All core queries with their reference SQL."""

from __future__ import annotations

from .operators import intervals, orphans
from .plans import catalog, lexical, records, search, signals, tasks, understanding

_MODULES = (orphans, intervals, search, lexical, catalog, understanding, tasks, signals, records)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
