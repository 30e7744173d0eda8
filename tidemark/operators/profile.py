"""Profiling: distributions, summary statistics, histograms, terms, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rules import EXPLORER_TEXT_NAMES
from tidemark.functions.stopwords import ENGLISH
from tidemark.operators.common import null_safe_join, small_table, windowed
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.sampling import sample_exact

QUARTILES = (0.25, 0.5, 0.75)
WORD = r"(?U)\w{2,}"


def label_distribution(df: DataFrame, col: str = "label") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("count")).orderBy(col)


def source_distribution(df: DataFrame, col: str = "source_dataset") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(col))


def source_by_label(df: DataFrame, labels: Sequence[int] = (0, 1), col: str = "source_dataset") -> DataFrame:
    """Counts per source and label, sources by total descending."""
    counts = [F.count_if(F.col("label") == v).alias(f"label_{v}") for v in labels]
    table = df.groupBy(col).agg(F.count("*").alias("total"), *counts)
    return table.orderBy(F.desc("total"), F.asc(col))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (and group).

    ``bounded`` columns (text lengths) use ``percentile`` in the same pass;
    otherwise the quartiles come from ``exact_quantiles``."""
    by = list(by)

    def stats(c: str, quartiles: Column | None) -> Column:
        fields = [
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
        ]
        if quartiles is not None:
            fields.append(quartiles.alias("q"))
        return F.struct(*fields, F.max(c).cast("double").alias("max")).alias(c)

    probs = F.array(*[F.lit(p) for p in QUARTILES])
    rows = df.groupBy(*by).agg(*[stats(c, F.percentile(c, probs) if bounded else None) for c in cols])
    long = rows.select(*by, F.explode(F.array(*cols)).alias("s")).select(*by, "s.*")
    if not bounded:
        wide = exact_quantiles(df, cols, QUARTILES, by)
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in cols])
        quartiles = wide.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*")
        long = null_safe_join(long, quartiles, [*by, "column"])
    return long.select(
        *by, "column", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(QUARTILES)], "max",
    )


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    width = (high - low) / F.lit(float(bins))
    place = F.when(width == 0, 0).otherwise(F.floor((x - low) / width))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over the column's range; the last bin is closed and
    empty bins are kept (per group too, over the common range)."""
    by = list(by)
    # nulls fall into a null bin, which no slot joins; a filter here would be
    # pushed down and compute a derived column twice
    values = df.select(*by, F.col(col).cast("double").alias("_x"))
    span = values.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("s")).scalar()
    tagged = values.withColumn("_s", span).withColumn(
        "bin", _bin(F.col("_x"), F.col("_s.lo"), F.col("_s.hi"), bins)
    )
    counts = tagged.groupBy(*by, "bin").agg(F.count("*").alias("count"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = null_safe_join(groups.select(*by, slots), counts, [*by, "bin"], "left")
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    return full.withColumn("_s", span).select(
        *by,
        "bin",
        (F.col("_s.lo") + F.col("bin") * width).alias("low"),
        (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def score_density(df: DataFrame, score: str, by: str = "label", bins: int = 50) -> DataFrame:
    """Histogram per label, normalised to unit area."""
    table = histogram(df, score, bins, [by])
    width = F.col("high") - F.col("low")
    size = F.sum("count").over(windowed([by]))
    return table.withColumn("density", F.col("count") / (size * width))


def boxplot_stats(df: DataFrame, col: str, by: str = "label") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (extreme values inside the fences) and outliers.

    Whiskers and outliers come from (group, value, count) rows, summed per task."""
    quart = exact_quantiles(df, [col], QUARTILES, [by]).withColumnRenamed(col, "q")
    quart = quart.select(
        by,
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )
    counts = df.groupBy(by, F.col(col).cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )
    joined = null_safe_join(counts, small_table(quart), [by])
    inside = F.col("v").between(F.col("q25") - 1.5 * F.col("iqr"), F.col("q75") + 1.5 * F.col("iqr"))
    return joined.groupBy(by, "q25", "median", "q75", "iqr").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def top_terms(
    df: DataFrame,
    label: int | None = 1,
    k: int = 20,
    vocabulary: int = 1000,
    stop_words: Sequence[str] = ENGLISH,
    text_col: str = "prompt",
) -> DataFrame:
    """Most frequent words of a class.  Counting pre-aggregates per task, and
    the cut to the vocabulary is a top-k, not a sort."""
    stop = list(stop_words)
    rows = df if label is None else df.where(F.col("label") == label)
    terms = rows.select(F.explode_outer(words(F.col(text_col))).alias("word"))
    counts = terms.where(F.col("word").isNotNull() & ~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("count"))
    ranked = [F.desc("count"), F.asc("word")]
    return counts.orderBy(*ranked).limit(vocabulary).orderBy(*ranked).limit(k)


def sample_by_label(df: DataFrame, id_col: str = "row_id", n: int = 10, seed: int = 42) -> DataFrame:
    return sample_exact(df, id_col, n, ["label"], seed)


def preview_sample(df: DataFrame, id_col: str = "row_id", n: int = 10, seed: int = 42) -> DataFrame:
    return sample_exact(df, id_col, n, (), seed)


def detect_text_column(df: DataFrame, names: Sequence[str] = EXPLORER_TEXT_NAMES) -> str | None:
    """First column, in table order, whose lower-case name is a known text name."""
    return next((c for c in df.columns if c.lower() in names), None)


def sample_prompts(
    df: DataFrame, id_col: str, n: int = 15, max_chars: int = 4000, seed: int = 42
) -> DataFrame:
    """``n`` non-null values of the text column; nested values as JSON, long ones cut."""
    name = detect_text_column(df)
    if name is None:
        raise ValueError(f"No text column among {df.columns}")
    chosen = sample_exact(df.where(F.col(name).isNotNull()), id_col, n, (), seed)
    nested = isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType))
    text = F.to_json(name) if nested else F.col(name).cast("string")
    cut = F.when(F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("..."))).otherwise(text)
    return chosen.select(id_col, cut.alias("sample"))
