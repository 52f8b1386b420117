"""All queries by name and the SQL of each."""

from __future__ import annotations

from newsloom.plans import decisions, details, proposals, queries, reading, upkeep, validation
from newsloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = queries.v1

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "decisions", "details", "proposals", "reading", "upkeep", "validation"]
