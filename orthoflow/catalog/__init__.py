"""Runnable queries over the standard tables, with the SQL that must give the same rows."""

from orthoflow.catalog import lexicon_queries, maintained_queries, record_queries, review_queries, text_queries  # noqa: F401
from orthoflow.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
