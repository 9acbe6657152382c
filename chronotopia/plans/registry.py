"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import book_queries, encounter_queries, kept, saved

PARTS = (encounter_queries, book_queries, saved, kept)
QUERIES = {k: q for p in PARTS for k, q in p.QUERIES.items()}
ORACLES = {k: q for p in PARTS for k, q in p.ORACLES.items()}
