"""Writers: CSV, splits partitioned by name, metric reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headed CSV that ``read_csv`` reads back, line breaks and quotes included."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split; each task writes its own rows, nothing is shuffled."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_metrics_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
