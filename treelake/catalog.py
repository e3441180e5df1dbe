"""All registered queries of the tree store, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import queries_fill, queries_more, queries_ops  # noqa: F401  they register their queries
from .plans.queries import ORACLE as ORACLE_SQL
from .plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
