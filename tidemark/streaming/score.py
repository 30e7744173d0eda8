"""The scoring plan on an unbounded table of prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files appearing under a path; the schema is declared, not inferred."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_score(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
):
    """Append scored rows to parquet.  Scoring is stateless: no watermark, and
    the file sink with its checkpoint writes each input row once."""
    return (
        score(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_available(stream: DataFrame, score: Callable[[DataFrame], DataFrame], timeout: int = 3600) -> DataFrame:
    """Drain what is available now and return the sink as a table."""
    spark = stream.sparkSession
    output, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "progress")
    query = stream_score(stream, score, output, checkpoint)
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("The stream did not finish")
    finally:
        query.stop()
    return spark.read.schema(score(stream).schema).parquet(output)
