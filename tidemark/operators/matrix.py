"""Feature-matrix preparation: select, fill, drop, scale, PCA.

Fitting returns a few numbers per column; applying is a narrow projection.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import as_double, l2_norm
from tidemark.operators.build import with_class_weight
from tidemark.operators.common import windowed
from tidemark.operators.importance import forest_importance
from tidemark.operators.quantiles import exact_quantiles


FOREST_ROWS = 5_000  # rows up to which the driver can hold the nodes of a batch of Spark's trees


def literal_array(values) -> Column:
    """Array constant; one foldable expression however many values."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


# ---- selection ---------------------------------------------------------


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    present = set(df.columns)
    cols = [F.col(c) if c in present else F.lit(0.0).alias(c) for c in names]
    return df.select(*keep, *cols)


def fill_missing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df).select("_v")
    return Correlation.corr(vectors, "_v").first()[0].toArray()


def correlation_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per pair of columns; a constant column has no correlation."""
    matrix = correlations(df, cols)
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if i < j
    ]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def correlated_columns(df: DataFrame, cols: Sequence[str], cutoff: float = 0.95) -> list[str]:
    """Columns to drop: any that correlates above the cutoff with an earlier kept one."""
    matrix, kept, dropped = np.abs(correlations(df, cols)), [], []
    for j in range(len(cols)):
        (dropped if any(matrix[i, j] > cutoff for i in kept) else kept).append(j)
    return [cols[j] for j in dropped]


def drop_correlated(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def variance_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in cols]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def variance_select(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> list[str]:
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


# ---- scaling -----------------------------------------------------------


@dataclass(frozen=True)
class LinearScaler:
    """(x - centre) / scale per column; a zero scale counts as one."""

    centre: Mapping[str, float]
    scale: Mapping[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.scale[c] or 1.0)
                for c in self.centre
            }
        )


def fit_standard(df: DataFrame, cols: Sequence[str]) -> LinearScaler:
    aggs = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]
    row = df.agg(*aggs).first()
    return LinearScaler({c: row[c]["m"] for c in cols}, {c: row[c]["s"] for c in cols})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> LinearScaler:
    row = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).first()
    return LinearScaler({c: row[c][1] for c in cols}, {c: row[c][2] - row[c][0] for c in cols})


# --- fixed values: coefficients of the standard rational approximation AS 241
# of the normal quantile (central region, then the two tails)
AS241 = {
    "centre": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
         1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
         3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
         2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
         5.2264952788528545610e3),
    ),
    "near": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
         3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
         2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
         1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
         2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
         2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
         2.04426310338993978564e-15),
    ),
}


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function, 0 < p < 1."""

    def ratio(region: str, r: np.ndarray) -> np.ndarray:
        top, bottom = AS241[region]
        return np.polyval(top[::-1], r) / np.polyval(bottom[::-1], r)

    q = p - 0.5
    middle = np.abs(q) <= 0.425
    tail = np.sqrt(-np.log(np.where(middle, 0.5, np.minimum(p, 1.0 - p))))
    near = ratio("near", tail - 1.6)
    outer = np.sign(q) * np.where(tail <= 5.0, near, ratio("far", tail - 5.0))
    return np.where(middle, q * ratio("centre", 0.180625 - q * q), outer)


BOUND = 1e-7  # share cut off at each end before the normal quantile


@dataclass(frozen=True)
class QuantileScaler:
    """Empirical quantile of each value, then the standard normal quantile."""

    columns: tuple[str, ...]
    landmarks: np.ndarray  # columns x quantiles, bounded: at most 1000 per column

    def transform(self, values: np.ndarray) -> np.ndarray:
        grid = np.linspace(0.0, 1.0, self.landmarks.shape[1])
        out = np.empty_like(values, dtype=np.float64)
        for j, marks in enumerate(self.landmarks):
            x = values[:, j]
            # ties between landmarks: the mean of both one-sided readings
            below = np.interp(x, marks, grid)
            above = -np.interp(-x, -marks[::-1], -grid[::-1])
            share = 0.5 * (below + above)
            share = np.where(x <= marks[0], 0.0, np.where(x >= marks[-1], 1.0, share))
            out[:, j] = normal_quantile(np.clip(share, BOUND, 1.0 - BOUND))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.DoubleType()) for c in self.columns])
        scaler = self

        @F.pandas_udf(schema)
        def scaled(frame: pd.DataFrame) -> pd.DataFrame:
            values = frame.to_numpy(dtype=np.float64)
            return pd.DataFrame(scaler.transform(values), columns=list(scaler.columns))

        packed = F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns])
        rest = [c for c in df.columns if c not in self.columns]
        tagged = df.withColumn("_scaled", scaled(packed))
        return tagged.select(*rest, *[F.col(f"_scaled.{c}").alias(c) for c in self.columns])


def fit_quantile_normal(df: DataFrame, cols: Sequence[str], rows: int | None = None) -> QuantileScaler:
    """Landmarks at evenly spaced ranks: min(1000, max(100, rows)), at most ``rows``."""
    rows = df.count() if rows is None else rows
    count = max(2, min(1000, max(100, rows), max(rows, 1)))
    probs = [i / (count - 1) for i in range(count)]
    row = exact_quantiles(df, cols, probs).first()
    return QuantileScaler(tuple(cols), np.array([row[c] for c in cols], dtype=np.float64))


# ---- embeddings --------------------------------------------------------


def embedding_stats(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumns(
        {"embedding_dimension": F.size(col), "embedding_norm": l2_norm(F.col(col))}
    )


def vector_mean(df: DataFrame, col: str) -> np.ndarray:
    return df.select(Summarizer.mean(array_to_vector(as_double(F.col(col))))).first()[0].toArray()


def covariance(df: DataFrame, col: str) -> np.ndarray:
    """Sample covariance of an array column, by tree aggregation in the JVM."""
    vectors = df.select(array_to_vector(as_double(F.col(col))).alias("_v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "_v")).computeCovariance().toArray()


@dataclass(frozen=True)
class PcaProjection:
    """Centred principal components with a fixed sign."""

    mean: np.ndarray
    components: np.ndarray  # dimensions x k
    explained: np.ndarray

    def project(self, df: DataFrame, col: str = "embedding", out: str = "pca") -> DataFrame:
        mean, components = self.mean, self.components

        @F.pandas_udf("array<double>")
        def projected(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=object)
            out, some = pd.Series([None] * len(batch), dtype=object), batch.notna().to_numpy()
            if some.any():
                x = np.stack(batch[some].to_numpy()).astype(np.float64)
                out[some] = pd.Series(list((x - mean) @ components), index=np.flatnonzero(some))
            return out

        return df.withColumn(out, projected(F.col(col)))

    def explained_variance_sum(self) -> float:
        return float(self.explained.sum())


def fit_pca(df: DataFrame, col: str = "embedding", k: int = 32) -> PcaProjection:
    """Spark's PCA; the driver sees one d x d covariance.  Spark neither centres
    the projected rows nor fixes signs: the mean is kept, and each component is
    turned so that its largest loading is positive."""
    vectors = df.select(array_to_vector(as_double(F.col(col))).alias("_v")).persist()
    mean = vectors.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    model = PCA(k=min(k, len(mean)), inputCol="_v", outputCol="_p").fit(vectors)
    vectors.unpersist()
    loadings = model.pc.toArray()
    peak = loadings[np.abs(loadings).argmax(axis=0), range(loadings.shape[1])]
    return PcaProjection(mean, loadings * np.sign(peak), model.explainedVariance.toArray())


def spread_columns(df: DataFrame, col: str, prefix: str, width: int) -> DataFrame:
    """Array to ``prefix_1..width`` columns; a short array gives 0.0, a null one nulls."""
    parts = [F.when(F.col(col).isNotNull(), F.coalesce(F.get(col, F.lit(i)), F.lit(0.0))).alias(f"{prefix}_{i + 1}") for i in range(width)]
    return df.select(*[c for c in df.columns if c != col], *parts)


# ---- importance --------------------------------------------------------


def rf_importance(
    df: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 400, seed: int = 42, depth: int = 30, batch: int = 100
) -> DataFrame:
    """Mean importance of each feature over ``trees`` trees with balanced class weights.

    Nodes grow until they are pure or ``depth`` (30, Spark's most) deep.  Up to
    ``FOREST_ROWS`` rows Spark's trees are fitted ``batch`` at a time, each batch from a seed
    of its own, which bounds the statistics and nodes that a fit holds; the batches'
    importances are averaged by their trees.  The node that a row has come to is kept between
    levels, not sought from the root again.  The driver holds all nodes of a batch, which
    grow with the rows; beyond, trees of the same kind are grown in the tasks, which hold
    the rows at a byte a feature, and only importances meet the driver."""
    weighted = with_class_weight(df.withColumn("label", F.col(label).cast("int"))).select(*cols, "label", "weight").persist()
    sizes = {r["label"]: (r["n"], r["weight"]) for r in weighted.groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).collect()}
    if sum(n for n, _ in sizes.values()) <= FOREST_ROWS:
        scores = spark_importance(weighted, cols, trees, seed, depth, batch)
    else:
        if set(sizes) - {0, 1} or not weighted.where(reduce(Column.__or__, [F.col(c).isNull() | F.isnan(c) for c in cols])).isEmpty():
            raise ValueError("Labels must be 0 or 1, and features must be known")
        scores = forest_importance(weighted, cols, "label", [sizes.get(k, (0, 0.0))[1] for k in (0, 1)], trees, seed, depth)
    weighted.unpersist()
    rows = [(c, float(s)) for c, s in zip(cols, scores)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), F.asc("feature"))


def spark_importance(weighted: DataFrame, cols: Sequence[str], trees: int, seed: int, depth: int, batch: int) -> np.ndarray:
    """The same by Spark's forests of rows with ``label`` and ``weight``."""
    data = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(weighted)
    data = data.select("_v", "label", "weight").persist()
    scores = np.zeros(len(cols))
    for i, at in enumerate(range(0, trees, batch)):
        n = min(batch, trees - at)
        forest = RandomForestClassifier(
            labelCol="label", featuresCol="_v", weightCol="weight", numTrees=n, maxDepth=depth, seed=seed + i,
            cacheNodeIds=True,
        )
        scores += n * forest.fit(data).featureImportances.toArray()
    data.unpersist()
    return scores / trees


def select_by_importance(table: DataFrame, threshold: float = 0.005, fallback: int = 20) -> DataFrame:
    """Features at or above the threshold; if there is none, the top ones."""
    best = table.agg(F.max("importance")).scalar()
    ranked = table.withColumn("_rank", F.row_number().over(windowed([], F.desc("importance"), F.asc("feature")))).withColumn("_best", best)
    keep = (F.col("importance") >= threshold) | ((F.col("_best") < threshold) & (F.col("_rank") <= fallback))
    return ranked.where(keep).select("feature", "importance")
