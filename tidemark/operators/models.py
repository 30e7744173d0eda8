"""Trained classifiers on feature columns: logistic regression and MLP."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import total
from tidemark.operators.build import with_class_weight
from tidemark.operators.evaluate import summary_scores
from tidemark.operators.matrix import literal_array


class MacroF1(Evaluator):
    """Unweighted mean of the per-class F1 (Spark's own "f1" weighs by support)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))
        return float(summary_scores(rows).first()["macro_f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


@dataclass(frozen=True)
class LinearClassifier:
    """Binary linear model as logits ``[0, w.x + b]``; scoring is one expression."""

    features: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float

    def logits(self) -> Column:
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        margin = total(F.zip_with(x, literal_array(self.coefficients), lambda a, b: a * b))
        return F.array(F.lit(0.0), margin + F.lit(float(self.intercept)))


def _assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    weighted = with_class_weight(df.withColumn("label", F.col("label").cast("int")))
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(weighted)


def fit_text_classifier(
    train: DataFrame, cols: Sequence[str], grid: Sequence[float] = (0.001, 0.01, 0.1),
    max_iter: int = 50, seed: int = 42, parallelism: int = 2,
) -> LinearClassifier:
    """Class-weighted logistic regression; regularisation chosen by macro-F1."""
    data = _assembled(train, cols).select("features", "label", "weight").persist()
    regression = LogisticRegression(maxIter=max_iter, weightCol="weight", family="binomial")
    params = ParamGridBuilder().addGrid(regression.regParam, list(grid)).build()
    if len(params) > 1:
        search = TrainValidationSplit(
            estimator=regression, estimatorParamMaps=params, evaluator=MacroF1(),
            trainRatio=0.8, seed=seed, parallelism=parallelism,
        )
        model = search.fit(data).bestModel
    else:
        model = regression.fit(data, params[0])
    data.unpersist()
    return LinearClassifier(tuple(cols), model.coefficients.toArray(), float(model.intercept))


def fit_mlp(
    train: DataFrame, cols: Sequence[str], hidden: Sequence[Sequence[int]] = ((64, 32, 16), (32, 32, 32)),
    max_iter: int = 40, seed: int = 42, parallelism: int = 2,
):
    """Dense net with three hidden layers; the layout is chosen by macro-F1."""
    data = _assembled(train, cols).select("features", "label").persist()
    net = MultilayerPerceptronClassifier(maxIter=max_iter, seed=seed, blockSize=64)
    layouts = [[len(cols), *h, 2] for h in hidden]
    grid = ParamGridBuilder().addGrid(net.layers, layouts).build()
    if len(grid) == 1:
        model = net.fit(data, grid[0])
        data.unpersist()
        return model
    search = TrainValidationSplit(
        estimator=net, estimatorParamMaps=grid, evaluator=MacroF1(), trainRatio=0.8, seed=seed, parallelism=parallelism
    )
    model = search.fit(data).bestModel
    data.unpersist()
    return model


def batch_predict(df: DataFrame, model, cols: Sequence[str]) -> DataFrame:
    """Apply a fitted ML model; adds ``pred`` and the positive-class ``score``."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    scored = model.transform(rows)
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability")[1].alias("score"),
    )
