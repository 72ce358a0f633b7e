"""The registered queries and their SQL, by module."""

from __future__ import annotations

from . import documents, extraction, injection, matching, retrieval, rows

MODULES = [matching, documents, rows, retrieval, extraction, injection]
QUERIES: dict = {k: v for m in MODULES for k, v in m.BOOK.queries.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.BOOK.sql.items()}
