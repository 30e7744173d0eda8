"""Queries of this subpackage by name, and their SQL."""

from tidemark.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
