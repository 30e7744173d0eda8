"""Bring differently labelled sources to ``prompt, label, source_dataset``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import BENIGN_WORDS, FALSE_WORDS, LABEL_NAMES, TRUE_WORDS
from tidemark.functions.text import strip_ws


@dataclass(frozen=True)
class SourceConfig:
    name: str
    prompt_col: str
    label_col: str
    malicious_value: Any
    benign_value: Any


def filter_known_labels(df: DataFrame, label_col: str, malicious: Any, benign: Any) -> DataFrame:
    return df.where(F.col(label_col).isin(malicious, benign))


def map_label(col: Column, malicious: Any, benign: Any) -> Column:
    return F.when(col == F.lit(malicious), 1).when(col == F.lit(benign), 0)


def standardize(df: DataFrame, cfg: SourceConfig, keep: Sequence[str] = ()) -> DataFrame:
    known = filter_known_labels(df, cfg.label_col, cfg.malicious_value, cfg.benign_value)
    label = map_label(F.col(cfg.label_col), cfg.malicious_value, cfg.benign_value)
    return known.select(
        *keep,
        strip_ws(F.col(cfg.prompt_col).cast("string")).alias("prompt"),
        label.cast("int").alias("label"),
        F.lit(cfg.name).alias("source_dataset"),
    )


def merge_sources(parts: Iterable[tuple[DataFrame, SourceConfig]], keep: Sequence[str] = ()) -> DataFrame:
    return reduce(DataFrame.unionByName, [standardize(df, cfg, keep) for df, cfg in parts])


def source_summary(merged: DataFrame, configs: Iterable[SourceConfig] = ()) -> DataFrame:
    """Rows kept and class counts per source, with the columns each one used."""
    summary = merged.groupBy(F.col("source_dataset").alias("dataset")).agg(
        F.count("*").alias("rows_kept"),
        F.count_if(F.col("label") == 1).alias("malicious_count"),
        F.count_if(F.col("label") == 0).alias("benign_count"),
    )

    def used(attr: str) -> Column:
        col = F.lit(None).cast("string")
        for cfg in configs:
            col = F.when(F.col("dataset") == cfg.name, getattr(cfg, attr)).otherwise(col)
        return col

    return summary.withColumns(
        {"prompt_column_used": used("prompt_col"), "label_column_used": used("label_col")}
    )


def label_name(col: Column, names: Mapping[int, str] = LABEL_NAMES) -> Column:
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(col == key, name).otherwise(out)
    return out


def parse_benign(col: Column, benign_words: Sequence[str] = BENIGN_WORDS) -> Column:
    """Boolean-like words first, then the benign list; null is not benign."""
    word = F.lower(strip_ws(col.cast("string")))
    listed = [w.strip().lower() for w in benign_words if w.strip()]
    return (
        F.when(word.isNull() | word.isin(*TRUE_WORDS), False)
        .when(word.isin(*FALSE_WORDS), True)
        .otherwise(word.isin(*listed) if listed else F.lit(False))
    )


def validate_length(df: DataFrame, text_col: str = "prompt", low: int = 1, high: int = 20000) -> DataFrame:
    """Add ``is_valid``: raw length within bounds; a null prompt is invalid."""
    size = F.length(text_col)
    return df.withColumn("is_valid", F.coalesce(size.between(low, high), F.lit(False)))


def split_valid(df: DataFrame, text_col: str = "prompt", low: int = 1, high: int = 20000):
    """(accepted rows, rejected rows)."""
    checked = validate_length(df, text_col, low, high)
    return checked.where("is_valid").drop("is_valid"), checked.where("not is_valid").drop("is_valid")
