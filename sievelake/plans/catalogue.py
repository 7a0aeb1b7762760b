"""All core queries and their SQL."""

from __future__ import annotations

from sievelake.plans import problems, search, store, texts

QUERIES = problems.QUERIES | search.QUERIES | store.QUERIES | texts.QUERIES
SQL = problems.SQL | search.SQL | store.SQL | texts.SQL
