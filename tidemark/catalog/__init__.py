"""Registered queries: a Spark callable per name and, where SQL can say the same
thing, the SQL."""

from tidemark.catalog import corpus, evaluation, features, models, profiling
from tidemark.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus", "evaluation", "features", "models", "profiling"]
