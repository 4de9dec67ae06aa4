"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from binforge.plans import file_queries, queries

QUERIES, SQL, flagship = queries.QUERIES, queries.SQL, queries.flagship
MODULES = (queries, file_queries)
