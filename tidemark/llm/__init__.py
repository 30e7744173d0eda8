"""Operators for large training corpora: deduplication, quality, search, tokens,
secrets and decontamination.  Nothing else in the library imports this package."""
