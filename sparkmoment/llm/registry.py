"""All queries of the subpackage with their reference SQL."""

from __future__ import annotations

from . import canon, leak, nearest_time, neighbours, ranking, spans, survivor, tokenize

_MODULES = (canon, tokenize, leak, spans, nearest_time, neighbours, ranking, survivor)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
