"""Dataset build: deduplicate, drop short texts, cap classes, split, weigh."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_ws
from tidemark.operators.common import null_safe_join, small_table, windowed
from tidemark.operators.harmonise import label_name
from tidemark.operators.sampling import sample_exact, split_by_rank

BUILD_FRACTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}
ANOMALY_FRACTIONS = {"train": 0.60, "val": 0.20, "test": 0.20}
TEST_FIRST_FRACTIONS = {"test": 0.15, "val": 0.15, "train": 0.70}
HOLDOUT_FRACTIONS = {"train": 0.90, "holdout": 0.10}
CLASS_CAP = 15_000
MIN_CHARS = 5


def dedup_key(col: Column) -> Column:
    return F.md5(F.lower(strip_ws(col)))


def dedup_ids(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """First id of each normalised text.  Keys and ids only are shuffled and
    ``min`` pre-aggregates, so a text with a third of the copies is no hot group."""
    return df.groupBy(dedup_key(F.col(text_col)).alias("text_hash")).agg(F.min(id_col).alias(id_col))


def dedup_normalized(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Keep the first row (by id) of each normalised text; ids are unique, so
    the join back has no hot key."""
    return df.join(dedup_ids(df, id_col, text_col).select(id_col), id_col, "left_semi")


def clean_short(df: DataFrame, min_len: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    stripped = df.withColumn(text_col, strip_ws(F.col(text_col)))
    return stripped.where(F.length(text_col) >= min_len)


def balance_classes(df: DataFrame, id_col: str = "row_id", cap: int = CLASS_CAP, seed: int = 42) -> DataFrame:
    return sample_exact(df, id_col, cap, ["label"], seed)


def stratified_split(
    df: DataFrame,
    id_col: str = "row_id",
    fractions: Mapping[str, float] = BUILD_FRACTIONS,
    by: Sequence[str] = ("label",),
    seed: int = 42,
) -> DataFrame:
    return split_by_rank(df, id_col, fractions, by, seed)


def build_dataset(
    df: DataFrame, id_col: str = "row_id", cap: int = CLASS_CAP, seed: int = 42
) -> DataFrame:
    """Deduplicate, clean, cap and split; ``split`` is a column, not a file."""
    kept = clean_short(dedup_normalized(df, id_col))
    named = kept.withColumn("label_name", label_name(F.col("label")))
    return stratified_split(balance_classes(named, id_col, cap, seed), id_col, seed=seed)


def split_metadata(splits: DataFrame) -> DataFrame:
    """Per split the rows of each label name and, as a null name, the total."""
    return splits.rollup("split", "label_name").agg(F.count("*").alias("rows")).where(
        F.col("split").isNotNull()
    )


def class_weights(df: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """total / (classes present * count); a class of the domain without rows counts one."""
    counts = df.groupBy("label").agg(F.count("*").alias("_n"))
    seen = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_classes"))
    domain = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v).cast("int") for v in labels])).alias("label")
    )
    joined = domain.join(counts, "label", "left").withColumn("_s", seen.select(F.struct("*")).scalar())
    weight = F.col("_s._total") / (F.col("_s._classes") * F.coalesce(F.col("_n"), F.lit(1))).cast("double")
    return joined.select("label", F.coalesce(F.col("_n"), F.lit(0)).alias("count"), weight.alias("weight"))


def with_class_weight(df: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows with their class weight; the weight table has one row per domain label."""
    weights = {r["label"]: r["weight"] for r in class_weights(df, labels).collect()}
    col = F.lit(None).cast("double")
    for label, weight in weights.items():
        col = F.when(F.col("label") == label, F.lit(weight)).otherwise(col)
    return df.withColumn("weight", col)


def benign_only(splits: DataFrame) -> DataFrame:
    return splits.where((F.col("split") == "train") & (F.col("label") == 0))


def label_shares(splits: DataFrame) -> DataFrame:
    counts = splits.groupBy("split", "label").agg(F.count("*").alias("rows"))
    share = F.col("rows") / F.sum("rows").over(windowed(["split"])).cast("double")
    return counts.withColumn("share", share)


def assign_row_id(df: DataFrame, *cols: str) -> DataFrame:
    """Reproducible id from content; equal rows get equal ids.  128 bits, since
    64 would collide at a trillion rows."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (cols or df.columns)]
    return df.withColumn("row_id", F.md5(F.concat_ws("\x1f", *parts)))


def encode_sources(df: DataFrame, col: str = "source_dataset") -> DataFrame:
    """Add the position of the source in the sorted list of sources.

    The list is broadcast if short, else joined by shuffle."""
    names = df.select(F.col(col).cast("string").alias(col)).distinct()
    codes = names.withColumn(f"{col}_encoded", (F.dense_rank().over(windowed([], F.col(col))) - 1).cast("int"))
    return null_safe_join(df, small_table(codes), [col])
