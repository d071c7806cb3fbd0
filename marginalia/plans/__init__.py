"""Registered queries, each with the SQL that states the same result where SQL can express it."""

from marginalia.plans import acting, changes, documents, prompting, relational, textual

_PARTS = (relational, textual, documents, changes, acting, prompting)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _PARTS for k, v in p.SQL.items()}
