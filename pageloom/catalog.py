"""All registered queries and their oracles: importing the modules registers what they have."""

from __future__ import annotations

from pageloom import queries, queries_documents, queries_functions, queries_pages  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
