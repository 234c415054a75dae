"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from lodeworks.plans import events, pages, pipeline, search, stream, text

MODULES = (text, search, events, pages, pipeline, stream)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
