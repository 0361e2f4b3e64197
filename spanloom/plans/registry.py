"""Queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from . import queries_corpus, queries_dictionary, queries_more, queries_resolve, queries_review, queries_sources, queries_text

FLAGSHIP = "dict_summary"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (queries_text, queries_dictionary, queries_resolve, queries_corpus, queries_review, queries_more, queries_sources):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
