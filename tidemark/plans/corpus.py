"""From many labelled sources to clean, balanced, split and engineered tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.features import PCA_WIDTH, TRAIN_FEATURES, text_features
from tidemark.operators.build import CLASS_CAP, build_dataset, encode_sources
from tidemark.operators.clean import clean
from tidemark.operators.harmonise import SourceConfig, merge_sources
from tidemark.operators.matrix import PcaProjection, embedding_stats, spread_columns


def cleaned_corpus(parts: Iterable[tuple[DataFrame, SourceConfig]]) -> DataFrame:
    return clean(merge_sources(parts))


def built_corpus(
    cleaned: DataFrame, id_col: str = "row_id", cap: int = CLASS_CAP, seed: int = 42
) -> DataFrame:
    """``text, label, label_name, split`` from ``row_id, prompt, label``."""
    return build_dataset(cleaned.withColumnRenamed("prompt", "text"), id_col, cap, seed)


def engineered_table(
    df: DataFrame, pca: PcaProjection, embedding: str = "embedding", width: int = PCA_WIDTH
) -> DataFrame:
    """``row_id, prompt, label, source_dataset``, 38 features and the components."""
    lexical = text_features(df, "train")
    coded = embedding_stats(encode_sources(lexical), embedding)
    wide = spread_columns(pca.project(coded, embedding, "_pca"), "_pca", "embed_pca", width)
    return wide.select(*engineered_columns(width))


def engineered_columns(width: int = PCA_WIDTH) -> Sequence[str]:
    return [
        "row_id", "prompt", "label", "source_dataset", *TRAIN_FEATURES,
        "source_dataset_encoded", "embedding_dimension", "embedding_norm",
        *[f"embed_pca_{i + 1}" for i in range(width)],
    ]


def chat_prompts(conversations: DataFrame) -> DataFrame:
    """User turns as prompts with a reproducible id."""
    return conversations.where(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("prompt_id"), F.col("text").alias("prompt")
    )
