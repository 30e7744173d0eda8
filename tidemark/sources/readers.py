"""Readers: CSV, JSON lines, parquet, dispatch by suffix, catalog."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.rules import LOADER_TEXT_NAMES


def read_csv(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    """Headed CSV with quoted multi-line text.  Without a schema the types are
    inferred, which reads the file twice."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_jsonl(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


FORMATS = {"csv": read_csv, "jsonl": read_jsonl, "ndjson": read_jsonl}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Reader by the ending of the path: ``FORMATS`` or parquet."""
    ending = os.path.basename(str(path).rstrip("/")).rpartition(".")[2].lower()
    if ending == "parquet":
        return read_parquet(spark, path)
    if ending not in FORMATS:
        raise ValueError(f"{path}: no reader for this ending, known are {sorted([*FORMATS, 'parquet'])}")
    return FORMATS[ending](spark, path, schema)


def read_many(spark: SparkSession, paths: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Union of several files of one source; a mapping tags rows with its ``split`` keys."""
    if isinstance(paths, Mapping):
        parts = [read_table(spark, p).withColumn("split", F.lit(name)) for name, p in paths.items()]
    else:
        parts = [read_table(spark, p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing columns {missing}; found {df.columns}")
    return df


def as_prompts(df: DataFrame, keep: Sequence[str] = (), names: Sequence[str] = LOADER_TEXT_NAMES) -> DataFrame:
    """``text, label``: ``text`` if present, else the first column with a known name."""
    text = "text" if "text" in df.columns else next((c for c in df.columns if c.lower() in names), None)
    if text is None:
        raise ValueError(f"No text column; found {df.columns}")
    require_columns(df, ["label"])
    return df.select(*keep, F.col(text).alias("text"), F.col("label").cast("int").alias("label"))


def load_prompts(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return as_prompts(read_table(spark, path, schema))


def load_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One split of a table written by ``write_splits`` (prunes to its folder)."""
    return spark.read.parquet(path).where(F.col("split") == name)


def dataset_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
