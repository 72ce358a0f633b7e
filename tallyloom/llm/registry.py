"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, contamination, gif, licenses, lines, neardup, quality, toxicity, urls

MODULES = [lines, gif, urls, toxicity, quality, licenses, neardup, chat, contamination, bpe]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
