"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col: Column) -> Column:
    return col.cast("array<double>")


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(col: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(col), lambda x: x * x)))


def softmax(logits: Column) -> Column:
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - peak))
    return F.transform(powers, lambda p: p / total(powers))


def squared_error_mean(x: Column, xhat: Column) -> Column:
    return total(F.zip_with(x, xhat, lambda a, b: (a - b) * (a - b))) / F.size(x)


def abs_error_max(x: Column, xhat: Column) -> Column:
    return F.array_max(F.zip_with(x, xhat, lambda a, b: F.abs(a - b)))


def stack_rows(series) -> np.ndarray:
    """Arrow batch of equally long arrays to a matrix."""
    if len(series) == 0:
        return np.empty((0, 0))
    return np.stack(series.to_numpy()).astype(np.float64)
