"""Every query of the core by name, and the SQL it is checked against."""

from __future__ import annotations

from tamarack.plans import films, imports, recommend, text_search

_PARTS = (imports, text_search, films, recommend)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in _PARTS for k, s in p.ORACLE.items()}
