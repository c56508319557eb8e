"""All core queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from skyloom.plans import basics, connectors, derived, ingest, matching, problems, sources

_PARTS = (problems, derived, matching, basics, ingest, connectors, sources)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
