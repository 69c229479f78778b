"""Queries over the testdata tables, by name, with their DuckDB counterparts."""

from __future__ import annotations

from foliospark.plans import ingest, operations, retrieval, service, text

_MODULES = (text, retrieval, operations, ingest, service)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
