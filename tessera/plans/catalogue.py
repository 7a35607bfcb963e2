"""All queries of the catalogue engine."""

from . import group_queries, ledger_queries, match_queries, picture_queries, record_queries, scalar_queries, scope_queries, view_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
