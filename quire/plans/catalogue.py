"""All registered queries of the document pipeline, and their SQL."""

from __future__ import annotations

from quire.plans import documents, edits, glossary, pages, render, store, streams, translation

MODULES = (documents, glossary, translation, store, render, edits, pages, streams)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
