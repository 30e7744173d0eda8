"""Helpers of the operators: stored tables, size-checked broadcasts, components."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

BROADCAST_ROWS = 500_000  # of a few numbers each: some 10 MB on the wire
MAX_ROUNDS = 60
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: cuts the
    lineage, survives lost executors, and later readers prune its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """``stored``, after which Spark drops the shuffle files of this one job at once and
    not at the driver's next garbage collection.  For large intermediate tables."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES)
    conf.set(DROP_SHUFFLES, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(DROP_SHUFFLES, before)


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Bounds the Arrow batches that go to the workers from now on, which the executor and the
    worker each hold whole.  Stays set, as plans run later; a session's own bound is kept."""
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, limit)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast if it has at most ``max_rows`` rows.  ``df``
    should be stored; beyond the bound the join shuffles and gives the same rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def worker_cache(name: str, make: Callable):
    """An object that outlives a task in its Python worker.  Code travels by value, so a
    module variable would be made anew in each task.  A worker keeps one such object: the
    next operator's takes the place of the last one's, whose memory is given back."""
    kept = sys.__dict__.setdefault("_tidemark_worker_cache", {})
    if name not in kept:
        if kept:
            kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        kept[name] = make()
    return kept[name]


def byte_slices(batch: pa.RecordBatch, limit: int = 2 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``limit`` bytes; a row is never cut."""
    each = max(1, min(rows, limit * batch.num_rows // max(1, batch.nbytes)))
    waiting = [batch.slice(at, each) for at in range(0, batch.num_rows, each)][::-1]
    while waiting:
        part = waiting.pop()
        if part.num_rows > 1 and part.nbytes > 2 * limit:
            half = part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u, v: long): ``node, component`` with the
    smallest node as the component, for every node that has an edge to another.

    Alternates large-star and small-star steps: each is a pre-aggregated minimum
    per node and one join back, so a node with most edges is a skewed join that
    Spark splits, never a group in one task.  Rounds grow with the logarithm of
    the longest path."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        around = both(e)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").distinct()

    now = stored(tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), name)
    mark = None
    for _ in range(MAX_ROUNDS):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        if not mark[0]:
            break
        now = stored(tidy(small_star(tidy(large_star(now)))), name)
    else:
        raise RuntimeError(f"{name}: no fixed point after {MAX_ROUNDS} rounds")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        tops.select("node", F.col("node").alias("component"))
    )


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case and nothing else; short ASCII strings take the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, lower))
