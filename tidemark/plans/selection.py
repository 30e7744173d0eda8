"""Detector search: fit candidates on benign rows, tune each on validation rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import (
    average_precision_from, curve_table, grid_winner, roc_auc_from, tune_threshold_from,
)
from tidemark.operators.forest import forest_scores
from tidemark.operators.neighbours import lof_scores
from tidemark.session import materialise

# --- fixed values: the two detector grids
FOREST_GRID = {
    "trees": (300, 500),
    "max_samples": ("auto", 0.8),
    "max_features": (0.8, 1.0),
    "bootstrap": (False, True),
    "contamination": ("auto", 0.01, 0.03),
}
LOF_GRID = {"k": (15, 25, 35), "p": (1, 2), "contamination": ("auto", 0.01, 0.03)}


def grid(options: Mapping[str, Iterable]) -> list[dict]:
    return [dict(zip(options, values)) for values in product(*options.values())]


def candidate_scores(train: DataFrame, val: DataFrame, id_col: str, col: str, forests=(), lofs=()) -> DataFrame:
    """``run, model, params, label, score`` of every candidate on the validation rows.

    Candidates share their work: forests of one structure are grown once and scored in
    common passes, and the factors of one metric come from one search."""
    train, val = materialise(train.select(id_col, col)), materialise(val.select(id_col, "label", col))
    forests, lofs = list(forests), list(lofs)
    parts = []
    if forests:
        scored = forest_scores(train, val, id_col, col, forests)
        parts.append(scored.select(F.col("model").alias("run"), F.lit("Isolation Forest").alias("model"), "label", "score"))
    if lofs:
        scored = lof_scores(train, val, id_col, col, lofs)
        parts.append(scored.select((F.col("model") + len(forests)).alias("run"), F.lit("Local Outlier Factor").alias("model"), "label", "score"))
    told = F.element_at(F.array(*[F.lit(str(p)) for p in forests + lofs]), F.col("run") + 1)
    return reduce(DataFrame.unionByName, parts).select("run", "model", told.alias("params"), "label", "score")


def detector_board(scores: DataFrame, objective: str = "f1", min_recall: float = 0.70) -> DataFrame:
    """One row per run: tuned threshold, its metrics, AUC and average precision.
    All of them come from one curve table."""
    by = ["run", "model", "params"]
    curve = curve_table(scores, by)
    tuned = tune_threshold_from(curve, by, objective, min_recall)
    ap = average_precision_from(curve, by).withColumnRenamed("average_precision", "avg_precision")
    return tuned.join(roc_auc_from(curve, by), by).join(ap, by)


def best_detector(board: DataFrame) -> DataFrame:
    return grid_winner(board, "run")
