"""Closed-form anomaly scores: Mahalanobis, reconstruction, robust z."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import abs_error_max, as_double, squared_error_mean
from tidemark.operators.matrix import PcaProjection, covariance, fit_pca
from tidemark.operators.quantiles import quantile_value

MAX_CLASSES = 10_000


# ---- Mahalanobis distance ----------------------------------------------


def class_means(df: DataFrame, col: str = "embedding", label: str = "label") -> DataFrame:
    """Rows, and mean vector as an array, per class."""
    vectors = df.select(label, array_to_vector(as_double(F.col(col))).alias("_v"))
    summary = vectors.groupBy(label).agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("s"))
    return summary.select(label, F.col("s.count").alias("rows"), vector_to_array("s.mean").alias("mean"))


def pooled_covariance(df: DataFrame, col: str = "embedding", label: str = "label"):
    """(class means, covariance of the class-centred rows over N - 1).

    The pooled scatter is the total scatter minus the scatter between classes,
    so one covariance pass suffices and no row is centred."""
    rows = class_means(df, col, label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"More than {MAX_CLASSES} classes in {label}")
    sizes = np.array([r["rows"] for r in rows], dtype=np.float64)
    means = np.array([r["mean"] for r in rows])
    n = sizes.sum()
    away = means - (sizes @ means) / n
    between = (away * sizes[:, None]).T @ away
    pooled = covariance(df, col) - between / (n - 1.0)
    return {r[label]: m for r, m in zip(rows, means)}, pooled


@dataclass(frozen=True)
class Mahalanobis:
    """Squared distance to the nearest class mean under the pooled covariance."""

    means: Mapping[int, np.ndarray]
    precision: np.ndarray
    pca: PcaProjection | None = None

    def score(self, df: DataFrame, col: str = "embedding", out: str = "ood_score") -> DataFrame:
        centres = np.stack(list(self.means.values()))
        precision, pca = self.precision, self.pca

        @F.pandas_udf("double")
        def distance(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype=np.float64)
            x = np.stack(batch.to_numpy()).astype(np.float64)
            if pca is not None:
                x = (x - pca.mean) @ pca.components
            best = np.full(len(x), np.inf)
            for centre in centres:
                diff = x - centre
                best = np.minimum(best, np.einsum("ij,jk,ik->i", diff, precision, diff, optimize=True))
            return pd.Series(best)

        return df.withColumn(out, distance(F.col(col)))


def fit_mahalanobis(
    df: DataFrame, col: str = "embedding", label: str = "label", components: int | None = 100
) -> Mahalanobis:
    pca = None
    data = df.select(col, label)
    if components is not None:
        pca = fit_pca(df, col, components)
        data, col = pca.project(data, col, "_reduced"), "_reduced"
    means, pooled = pooled_covariance(data, col, label)
    regular = pooled + np.eye(len(pooled)) * 1e-6
    try:
        precision = np.linalg.inv(regular)
    except np.linalg.LinAlgError:
        precision = np.linalg.pinv(regular)
    return Mahalanobis(means, precision, pca)


def calibrate_threshold(df: DataFrame, score: str = "ood_score", recall: float = 0.95) -> float:
    """Score below which ``recall`` of the in-distribution rows lie."""
    value = quantile_value(df, score, recall)
    if value is None:
        raise ValueError("No scores to calibrate on")
    return value


def predict_ood(df: DataFrame, threshold: float, score: str = "ood_score") -> DataFrame:
    """Strict rule: beyond the threshold."""
    return df.withColumn("is_ood", F.col(score) > F.lit(float(threshold)))


def msp_score(probs: Column) -> Column:
    return F.lit(1.0) - F.array_max(probs)


# ---- reconstruction ----------------------------------------------------


def reconstruction_errors(df: DataFrame, x: str = "x", xhat: str = "xhat") -> DataFrame:
    return df.withColumns(
        {
            "recon_mse": squared_error_mean(F.col(x), F.col(xhat)),
            "recon_max_abs": abs_error_max(F.col(x), F.col(xhat)),
        }
    )


def reconstruct_linear(df: DataFrame, pca: PcaProjection, x: str = "x", out: str = "xhat") -> DataFrame:
    """Projection on the components and back."""
    mean, components = pca.mean, pca.components

    @F.pandas_udf("array<double>")
    def back(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        z = np.stack(batch.to_numpy()).astype(np.float64) - mean
        return pd.Series(list(z @ components @ components.T + mean))

    return df.withColumn(out, back(F.col(x)))


#: Slope below zero that an activation has unless one is given (None: not piecewise linear).
ACTIVATIONS = {"linear": None, "relu": 0.0, "leaky_relu": 0.01, "elu": None, "gelu": None}


def erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x.ravel()]).reshape(x.shape)


@dataclass(frozen=True)
class Layer:
    """Given weights of one dense layer; batch-norm as scale and shift, and the
    slope of a leaky ReLU (None: linear output, or the activation named)."""

    weight: np.ndarray
    bias: np.ndarray
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None
    slope: float | None = None
    activation: str = "leaky_relu"

    def forward(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight.T + self.bias
        if self.scale is not None:
            y = y * self.scale + self.shift
        if self.activation == "elu":
            return np.where(y > 0, y, np.expm1(np.minimum(y, 0.0)))
        if self.activation == "gelu":
            return 0.5 * y * (1.0 + erf(y / math.sqrt(2.0)))
        return y if self.slope is None else np.where(y > 0, y, self.slope * y)


def batch_norm(weight, bias, mean, var, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Running statistics as (scale, shift)."""
    scale = weight / np.sqrt(var + eps)
    return scale, bias - mean * scale


def reconstruct(df: DataFrame, layers: Sequence[Layer], x: str = "x", out: str = "xhat") -> DataFrame:
    """Batch forward pass of given layers, by Arrow batch."""
    layers = list(layers)

    @F.pandas_udf("array<double>")
    def forward(batch: pd.Series) -> pd.Series:
        if len(batch) == 0:
            return pd.Series([], dtype=object)
        y = np.stack(batch.to_numpy()).astype(np.float64)
        for layer in layers:
            y = layer.forward(y)
        return pd.Series(list(y))

    return df.withColumn(out, forward(F.col(x)))


# ---- robust z and the hybrid score -------------------------------------


@dataclass(frozen=True)
class RobustZ:
    """Median and median absolute deviation; frozen, so streams can use it."""

    median: float
    mad: float

    def apply(self, col: Column) -> Column:
        return F.lit(0.6745) * (col - F.lit(self.median)) / F.lit(self.mad + 1e-9)


def fit_robust_z(df: DataFrame, col: str) -> RobustZ:
    median = quantile_value(df, col, 0.5)
    if median is None:
        raise ValueError(f"No values in {col}")
    away = df.select(F.abs(F.col(col) - F.lit(median)).alias("_away"))
    return RobustZ(median, quantile_value(away, "_away", 0.5))


def hybrid_score(df: DataFrame, mse: str = "recon_mse", max_abs: str = "recon_max_abs") -> DataFrame:
    """0.7 robust-z of the mean error + 0.3 robust-z of the largest error."""
    z_mse, z_max = fit_robust_z(df, mse), fit_robust_z(df, max_abs)
    return df.withColumn(
        "hybrid_score", F.lit(0.7) * z_mse.apply(F.col(mse)) + F.lit(0.3) * z_max.apply(F.col(max_abs))
    )
