"""Classification outputs, anomaly verdicts and their fusion into a decision."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import BAD_TONE_HINTS, BENIGN_HINTS, LABEL_NAMES, MALICIOUS_HINTS
from tidemark.functions.text import strip_ws
from tidemark.functions.vectors import softmax

MARGIN = 0.25
MALICIOUS_FROM = 2


def classify_scores(
    df: DataFrame,
    logits: str = "logits",
    names: Mapping[int, str] | None = LABEL_NAMES,
    classes: int | None = None,
    min_confidence: float = 0.0,
    decision_rule: str = "argmax",
    model_type: str = "sequence_classification",
) -> DataFrame:
    """Softmax, argmax, confidence, class map and uncertainty of a logits array.

    ``classes`` fixes the width; ids without a name are written as digits, and
    with no names at all as ``class_i``."""
    width = classes or len(names or ()) or 2
    known = {i: f"class_{i}" for i in range(width)} if names is None else names
    title = F.array(*[F.lit(known.get(i, str(i))) for i in range(width)])
    tagged = df.withColumn("_p", softmax(F.col(logits)))
    tagged = tagged.withColumn(
        "predicted_class_id", (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
    )
    confidence = F.get("_p", F.col("predicted_class_id"))
    return (
        tagged.withColumn("confidence", confidence)
        .withColumns(
            {
                "predicted_label": F.get(title, F.col("predicted_class_id")),
                "class_probabilities": F.map_from_arrays(title, F.col("_p")),
                "decision_rule": F.lit(decision_rule),
                "min_confidence": F.lit(float(min_confidence)),
                "is_uncertain": F.col("confidence") < F.lit(float(min_confidence)),
                "model_type": F.lit(model_type),
            }
        )
        .drop("_p")
    )


def anomaly_decision(
    df: DataFrame,
    score: str = "anomaly_score",
    threshold: Column | float = 0.0,
    score_name: str = "reconstruction_mse",
    model_type: str = "reconstruction",
) -> DataFrame:
    """Inclusive threshold rule with its labels."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    tagged = df.withColumn("threshold", limit)
    hit = F.col(score) >= F.col("threshold")
    return tagged.withColumns(
        {
            "is_anomalous": hit,
            "decision_label": F.when(hit, "malicious_or_anomalous").otherwise("benign_like"),
            "score_name": F.lit(score_name),
            "model_type": F.lit(model_type),
        }
    )


def has_hint(label: Column, hints) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(label, F.lit(h)) for h in hints])


def decide_prompt_risk(df: DataFrame) -> DataFrame:
    """Add ``risk_score, final_label, is_malicious, reasons``.

    Reads ``anomaly_score, threshold, is_anomalous, predicted_label, confidence,
    min_confidence, is_uncertain``.  The hint groups may both match a label."""
    label = F.lower(strip_ws(F.col("predicted_label")))
    score, limit, anomalous = F.col("anomaly_score"), F.col("threshold"), F.col("is_anomalous")
    confidence, needed, uncertain = F.col("confidence"), F.col("min_confidence"), F.col("is_uncertain")
    margin = score - limit
    sure = (confidence >= needed) & ~uncertain
    bad, good = F.col("_bad"), F.col("_good")
    staged = df.withColumns({"_bad": has_hint(label, MALICIOUS_HINTS), "_good": has_hint(label, BENIGN_HINTS)})

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    agree = anomalous & (uncertain | bad)
    risk = (
        points(anomalous, 2)
        + points(margin >= MARGIN, 1)
        + points(bad & sure, 3)
        + points(bad & ~sure, 1)
        + points(good & sure, -2)
        + points(agree, 1)
    )

    def said(template: str, *cols: Column) -> Column:
        return F.format_string(template, *cols)

    name = F.col("predicted_label")
    # fixed values: the reason texts, which users of the decisions match
    lines = [
        F.when(anomalous, said("anomaly_score_above_threshold (%.4f >= %.4f)", score, limit)).otherwise(
            said("anomaly_score_below_threshold (%.4f < %.4f)", score, limit)
        ),
        F.when(margin >= MARGIN, said("anomaly_margin_high (%.4f)", margin)),
        F.when(
            bad & sure,
            said("classifier_predicted_malicious_with_confidence (%s, confidence=%.4f)", name, confidence),
        ).when(
            bad,
            said("classifier_predicted_malicious_but_low_confidence (%s, confidence=%.4f)", name, confidence),
        ),
        F.when(
            good & sure,
            said("classifier_predicted_benign_with_confidence (%s, confidence=%.4f)", name, confidence),
        ).when(
            uncertain, said("classifier_uncertain (confidence=%.4f, min_confidence=%.4f)", confidence, needed)
        ),
        F.when(agree, "cross_signal_agreement_on_risk"),
    ]
    verdict = F.col("risk_score") >= MALICIOUS_FROM
    return (
        staged.withColumns({"risk_score": risk, "reasons": F.array_compact(F.array(*lines))})
        .withColumns(
            {
                "final_label": F.when(verdict, "malicious").otherwise("benign"),
                "is_malicious": verdict,
            }
        )
        .drop("_bad", "_good")
    )


def join_signals(anomaly: DataFrame, classification: DataFrame, id_col: str = "prompt_id"):
    """(joined rows, rejected ids): both results must exist and name the same prompt.

    One full join on the unique id; the rejects are its mismatches."""
    right = classification.withColumnsRenamed(
        {c: f"c_{c}" for c in classification.columns if c != id_col and c in anomaly.columns}
    )
    both = anomaly.withColumn("_a", F.lit(True)).join(
        right.withColumn("_c", F.lit(True)), id_col, "full_outer"
    )
    same = F.coalesce(F.col("_a") & F.col("_c") & (F.col("prompt") == F.col("c_prompt")), F.lit(False))
    reason = (
        F.when(F.col("_a").isNull(), "anomaly_missing")
        .when(F.col("_c").isNull(), "classification_missing")
        .otherwise("prompt_mismatch")
    )
    return (
        both.where(same).drop("_a", "_c", "c_prompt"),
        both.where(~same).select(id_col, reason.alias("reject_reason")),
    )


def allow_flag_block(df: DataFrame) -> DataFrame:
    action = (
        F.when(F.col("is_ood"), "FLAG").when(F.col("predicted_label") == "Benign", "ALLOW").otherwise("BLOCK")
    )
    return df.withColumn("action", action)


def class_tone(label: Column, uncertain: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(uncertain, "warn")
        .when(has_hint(low, BAD_TONE_HINTS), "bad")
        .when(has_hint(low, BENIGN_HINTS), "ok")
        .otherwise("neutral")
    )


def triage_tone(df: DataFrame) -> DataFrame:
    """Add ``class_tone`` and ``final_tone``."""
    unsure = (
        F.coalesce("is_uncertain", F.lit(False))
        | F.contains(F.lower(F.coalesce("final_label", F.lit(""))), F.lit("review"))
        | F.coalesce(F.exists("reasons", lambda r: F.contains(r, F.lit("uncertain"))), F.lit(False))
    )
    return df.withColumns(
        {
            "class_tone": class_tone(F.col("predicted_label"), F.col("is_uncertain")),
            "final_tone": F.when(F.col("is_malicious"), "bad").when(unsure, "warn").otherwise("ok"),
        }
    )


def decision_rows(df: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """Nested result rows: ``anomaly``, ``classification`` and the verdict."""
    def pack(*names: str) -> Column:
        return F.struct(*[F.col(n) for n in names])

    return df.select(
        id_col,
        pack("prompt", "prompt_normalized", "anomaly_score", "threshold", "is_anomalous",
             "decision_label", "feature_count", "score_name").alias("anomaly"),
        pack("prompt", "prompt_normalized", "predicted_label", "predicted_class_id", "confidence",
             "class_probabilities", "decision_rule", "min_confidence", "is_uncertain").alias("classification"),
        "final_label",
        "is_malicious",
        "reasons",
    )
