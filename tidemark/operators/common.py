"""Helpers shared by the operators: size-checked small tables, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL_ROWS = 10_000
WINDOW_ROWS = 2_000_000
BUCKETS = 1_000


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcastable copy of ``df`` if it has at most ``max_rows`` rows, else
    ``df`` itself, unhinted: the join then shuffles and AQE splits hot keys."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how="inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; ``right``'s keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def windowed(by: Sequence[str], *order: Column):
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return spec.orderBy(*order) if order else spec


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    max_window_rows: int = WINDOW_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``upto_<s>``: running sum of each ``s`` along ``order`` within ``by``.

    ``df`` holds one row per (by, order) and should be materialised, since the
    large path reads it three times.  Up to ``max_window_rows`` rows take one window
    per group.  Beyond that the order column is cut into buckets at its own
    quantiles, the windows run per (group, bucket), and the totals of the
    earlier buckets (at most ``buckets`` rows per group) are added.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if df.count() <= max_window_rows:
        w = windowed(by, direction)
        return df.withColumns({f"upto_{s}": F.sum(s).over(w) for s in sums})

    probs = [i / buckets for i in range(1, buckets)]
    cut_row = df.agg(F.percentile_approx(order, probs, 10 * buckets).alias("cuts")).first()
    splits = [float("-inf"), *sorted({float(c) for c in cut_row["cuts"]}), float("inf")]
    tagged = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(
        df.withColumn(order, F.col(order).cast("double"))
    )
    keys = [*by, "_bucket"]
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = windowed(by, bucket_order)
    totals = tagged.groupBy(*keys).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    totals = totals.select(
        *keys, *[(F.sum(f"_sum_{s}").over(before) - F.col(f"_sum_{s}")).alias(f"_off_{s}") for s in sums]
    )
    joined = null_safe_join(tagged, totals, keys)
    w = windowed(keys, direction)
    return joined.withColumns(
        {f"upto_{s}": F.col(f"_off_{s}") + F.sum(s).over(w) for s in sums}
    ).drop("_bucket", *[f"_off_{s}" for s in sums])
