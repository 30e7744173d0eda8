"""Prompt rows to explained decisions; the same expressions serve batch and stream.

All parameters are frozen numbers, so scoring is stateless and narrow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.features import ANOMALY_LEXICAL, text_features
from tidemark.functions.rules import LABEL_NAMES, PHRASE_RULES
from tidemark.functions.vectors import squared_error_mean
from tidemark.operators.anomaly import reconstruct_linear
from tidemark.operators.decide import anomaly_decision, classify_scores, decide_prompt_risk
from tidemark.operators.harmonise import split_valid
from tidemark.operators.matrix import LinearScaler, PcaProjection, fit_pca, fit_standard
from tidemark.operators.models import LinearClassifier, fit_text_classifier
from tidemark.operators.quantiles import quantile_value
from tidemark.session import materialise


@dataclass(frozen=True)
class ScoringModel:
    features: tuple[str, ...]
    scaler: LinearScaler
    coder: PcaProjection
    threshold: float
    classifier: LinearClassifier
    min_confidence: float = 0.6
    names: Mapping[int, str] = None
    rules: Mapping[str, Sequence[str]] = None


def scaled_features(df: DataFrame, features: Sequence[str], scaler: LinearScaler, rules) -> DataFrame:
    """Serve features, selected and scaled, as columns and as the array ``x``."""
    served = text_features(df, "serve", rules=rules, keep_text=True)
    missing = [c for c in features if c not in served.columns]
    ready = scaler.apply(served.withColumns({c: F.lit(0.0) for c in missing}) if missing else served)
    return ready.withColumn("x", F.array(*[F.col(c) for c in features]))


def fit_scoring(
    labelled: DataFrame,
    features: Sequence[str] = tuple(ANOMALY_LEXICAL),
    components: int = 8,
    target_fpr: float = 0.05,
    min_confidence: float = 0.6,
    rules: Mapping[str, Sequence[str]] = PHRASE_RULES,
) -> ScoringModel:
    """Scale and reconstruct on benign rows, calibrate the threshold there, and
    fit the classifier on all of them (``prompt, label``)."""
    served = materialise(
        text_features(labelled.select("prompt", "label"), "serve", rules=rules).select("label", *features)
    )
    scaler = fit_standard(served.where("label = 0"), features)
    scaled = scaler.apply(served).withColumn("x", F.array(*[F.col(c) for c in features]))
    benign = scaled.where("label = 0").select("x")
    coder = fit_pca(benign, "x", components)
    errors = reconstruct_linear(benign, coder).select(squared_error_mean(F.col("x"), F.col("xhat")).alias("e"))
    threshold = quantile_value(errors, "e", 1.0 - target_fpr)
    classifier = fit_text_classifier(scaled, features, grid=(0.01,))
    return ScoringModel(
        tuple(features), scaler, coder, threshold, classifier, min_confidence, LABEL_NAMES, rules
    )


def score_prompts(df: DataFrame, model: ScoringModel) -> DataFrame:
    """Add the anomaly, classification and decision columns to prompt rows."""
    rows = scaled_features(df, model.features, model.scaler, model.rules)
    logits = rows.withColumn("logits", model.classifier.logits())
    coded = reconstruct_linear(logits, model.coder)
    scored = coded.withColumns(
        {
            "anomaly_score": squared_error_mean(F.col("x"), F.col("xhat")),
            "feature_count": F.size("x"),
        }
    )
    judged = anomaly_decision(scored, threshold=model.threshold)
    classed = classify_scores(judged, names=model.names, min_confidence=model.min_confidence)
    decided = decide_prompt_risk(classed)
    return decided.select(
        *df.columns, "prompt_normalized", "anomaly_score", "threshold", "is_anomalous", "decision_label",
        "feature_count", "score_name", "predicted_label", "predicted_class_id", "confidence",
        "class_probabilities", "decision_rule", "min_confidence", "is_uncertain", "model_type",
        "risk_score", "final_label", "is_malicious", "reasons",
    )


def score_valid_prompts(df: DataFrame, model: ScoringModel) -> DataFrame:
    """Every prompt once: valid ones scored, the others with null scores and the
    reason in ``reject_reason`` (null for the scored)."""
    accepted, rejected = split_valid(df)
    scored = score_prompts(accepted, model).withColumn("reject_reason", F.lit(None).cast("string"))
    size = F.length("prompt")
    reason = F.when(size.isNull(), "missing").when(size < 1, "empty").otherwise("too long")
    return scored.unionByName(rejected.withColumn("reject_reason", reason), allowMissingColumns=True)
