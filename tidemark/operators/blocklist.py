"""Rule baseline: regular-expression blocklist on the lower-cased text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import BLOCKLIST


def required_literal(pattern: str) -> str | None:
    """A word that every match of the pattern contains, if one can be told:
    the longest run of letters outside groups and optional characters."""
    if re.search(r"[\[{]", pattern):
        return None
    while re.search(r"\([^()]*\)", pattern):
        pattern = re.sub(r"\([^()]*\)[?*+]?", " ", pattern)
    if "|" in pattern:
        return None
    plain = re.sub(r"\\.[?*+]?|.[?*]", " ", pattern)
    words = re.findall(r"[A-Za-z]{2,}", plain)
    return max(words, key=len) if words else None


def matches(lowered: Column, pattern: str) -> Column:
    """Regex match behind a substring test, which most texts fail."""
    hit = lowered.rlike(f"(?U){pattern}")
    word = required_literal(pattern)
    return F.contains(lowered, F.lit(word)) & hit if word else hit


def keyword_blocklist(
    df: DataFrame,
    text_col: str = "prompt",
    out: str = "pred",
    patterns: Mapping[str, Sequence[str]] = BLOCKLIST,
) -> DataFrame:
    """Add ``out``: 1 if any pattern matches the lower-cased text, else 0; a null text matches none."""
    tests = [matches(F.col("_low"), p) for group in patterns.values() for p in group]
    hit = reduce(lambda a, b: a | b, tests, F.lit(False))
    return df.withColumn("_low", F.lower(text_col)).withColumn(out, F.coalesce(hit, F.lit(False)).cast("int")).drop("_low")


def blocklist_hits(
    df: DataFrame, text_col: str = "prompt", patterns: Mapping[str, Sequence[str]] = BLOCKLIST
) -> DataFrame:
    """Add ``hits`` (ids ``family_i``) and ``hit_families``."""
    checks = [
        F.when(matches(F.col("_low"), p), f"{family}_{i + 1}")
        for family, group in patterns.items()
        for i, p in enumerate(group)
    ]
    tagged = df.withColumn("_low", F.lower(text_col)).withColumn("hits", F.array_compact(F.array(*checks)))
    families = F.transform("hits", lambda h: F.regexp_replace(h, "_[0-9]+$", ""))
    return tagged.withColumn("hit_families", F.array_distinct(families)).drop("_low")
