"""All registered queries."""

from __future__ import annotations

from . import analytics, exports, merging, streams, texts, transcripts

QUERIES: dict = {}
SQL: dict = {}
for module in (analytics, texts, merging, exports, transcripts, streams):
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)
