"""Evaluation: confusion, reports, exact curves, thresholds, calibration.

``predictions`` tables have ``label``, ``pred`` and/or ``score`` columns and may
hold several methods; every operator takes ``by`` for such groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import WINDOW_ROWS, null_safe_join, running_totals, small_table, windowed
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import materialise


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom.cast("double"))


# ---- confusion and reports ---------------------------------------------


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), label="label", pred="pred") -> DataFrame:
    """Counts over the grid of all classes seen as label or prediction."""
    by = list(by)
    counts = df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("count")
    )
    classes = counts.groupBy(*by).agg(
        F.array_union(F.collect_set("label"), F.collect_set("pred")).alias("_classes")
    )
    grid = classes.select(*by, "_classes", F.explode("_classes").alias("label")).select(
        *by, "label", F.explode("_classes").alias("pred")
    )
    full = null_safe_join(grid, counts, [*by, "label", "pred"], "left")
    return full.select(*by, "label", "pred", F.coalesce("count", F.lit(0)).alias("count"))


def confusion_normalized(df: DataFrame, by: Sequence[str] = (), label="label", pred="pred") -> DataFrame:
    table = confusion_matrix(df, by, label, pred)
    row = F.sum("count").over(windowed([*by, "label"]))
    return table.withColumn("share", ratio(F.col("count"), row))


def class_scores(df: DataFrame, by: Sequence[str] = (), label="label", pred="pred") -> DataFrame:
    """precision, recall, f1 and support per class, from pair counts."""
    by = list(by)
    pairs = df.groupBy(*by, F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    hit = F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("_l").alias("class"), F.col("_n").alias("s"), F.lit(0).cast("bigint").alias("p"), hit.alias("t")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("_n").alias("p"), F.lit(0).cast("bigint").alias("t")),
    )
    sums = (
        pairs.select(*by, F.explode(roles).alias("r"))
        .groupBy(*by, F.col("r.class").alias("class"))
        .agg(F.sum("r.s").alias("support"), F.sum("r.p").alias("_pred"), F.sum("r.t").alias("_tp"))
    )
    scored = sums.withColumns(
        {
            "precision": ratio(F.col("_tp"), F.col("_pred")),
            "recall": ratio(F.col("_tp"), F.col("support")),
            # 2PR/(P+R) in counts
            "f1": ratio(2 * F.col("_tp"), F.col("support") + F.col("_pred")),
        }
    )
    return scored.select(*by, "class", "precision", "recall", "f1", "support", "_tp")


def classification_report(df: DataFrame, by: Sequence[str] = (), label="label", pred="pred") -> DataFrame:
    """Rows per class, then ``accuracy`` (in every score column), ``macro avg``
    and ``weighted avg``."""
    by = list(by)
    classes = class_scores(df, by, label, pred)
    scores = ["precision", "recall", "f1"]

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    accuracy = ratio(F.sum("_tp"), F.sum("support"))
    sums = classes.groupBy(*by).agg(
        F.struct(*[accuracy.alias(c) for c in scores], F.sum("support").alias("support")).alias("accuracy"),
        F.struct(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support")).alias("macro avg"),
        F.struct(*[weighted(c).alias(c) for c in scores], F.sum("support").alias("support")).alias("weighted avg"),
    )
    rows = [
        F.struct(F.lit(n).alias("class"), *[F.col(f"`{n}`.{c}").alias(c) for c in [*scores, "support"]])
        for n in ("accuracy", "macro avg", "weighted avg")
    ]
    averages = sums.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    named = classes.drop("_tp").withColumn("class", F.col("class").cast("string"))
    return named.unionByName(averages)


def summary_scores(df: DataFrame, by: Sequence[str] = (), label="label", pred="pred") -> DataFrame:
    classes = class_scores(df, by, label, pred)
    return classes.groupBy(*by).agg(
        ratio(F.sum("_tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


# ---- curves ------------------------------------------------------------


def curve_table(
    df: DataFrame,
    by: Sequence[str] = (),
    score="score",
    label="label",
    max_window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per distinct score: positives and negatives at it (``pos, neg``),
    at or above it (``upto_pos, upto_neg``) and in total (``all_pos, all_neg``).

    Everything below reads this table.  It is checkpointed: the predictions are
    scanned once whatever is computed from the curve."""
    by = list(by)
    points = df.groupBy(*by, F.col(score).cast("double").alias("score"))
    counts = materialise(
        points.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ).where("score IS NOT NULL AND pos + neg > 0")
    run = running_totals(counts, by, "score", ["pos", "neg"], True, max_window_rows)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return null_safe_join(run, small_table(totals), by)


def roc_auc_from(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties half: no ordering needed."""
    won = F.col("neg") * (F.col("upto_pos") - F.col("pos") / F.lit(2.0))
    pairs = F.max("all_pos") * F.max("all_neg")
    return curve.groupBy(*by).agg(F.when(pairs > 0, F.sum(won) / pairs.cast("double")).alias("roc_auc"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), score="score", label="label", **kw) -> DataFrame:
    return roc_auc_from(curve_table(df, by, score, label, **kw), by)


def roc_auc_ovr(df: DataFrame, probs: str, label: str, classes: Sequence[int], **kw) -> DataFrame:
    """One-vs-rest: AUC per class; ``macro`` is their mean."""
    per_class = one_vs_rest(df, probs, label, classes)
    scored = roc_auc(per_class, ["class"], **kw)
    return scored.withColumn("macro", F.avg("roc_auc").over(windowed([])))


def one_vs_rest(df: DataFrame, probs: str, label: str, classes: Sequence[int]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            (F.col(label) == c).cast("int").alias("label"),
            F.get(probs, F.lit(i)).alias("score"),
        )
        for i, c in enumerate(classes)
    ]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def average_precision_from(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    step = F.col("pos") * F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg")).cast("double")
    return curve.groupBy(*by).agg(
        F.when(F.max("all_pos") > 0, F.sum(step) / F.max("all_pos").cast("double")).alias("average_precision")
    )


def average_precision(df: DataFrame, by: Sequence[str] = (), score="score", label="label", **kw) -> DataFrame:
    return average_precision_from(curve_table(df, by, score, label, **kw), by)


def roc_curve(df: DataFrame, by: Sequence[str] = (), score="score", label="label", **kw) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score and the origin (threshold null)."""
    by = list(by)
    curve = curve_table(df, by, score, label, **kw)
    points = curve.select(
        *by,
        ratio(F.col("upto_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("upto_pos"), F.col("all_pos")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    zero = F.lit(0.0)
    origin = curve.groupBy(*by).agg(F.max("all_pos")).select(
        *by, zero.alias("fpr"), zero.alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(origin)


def pr_points(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.select(
        *by,
        ratio(F.col("upto_pos"), F.col("upto_pos") + F.col("upto_neg")).alias("precision"),
        ratio(F.col("upto_pos"), F.col("all_pos"), 1.0).alias("recall"),
        F.col("score").alias("threshold"),
        (F.col("upto_pos") - F.col("pos")).alias("_tp"),
        (F.col("upto_neg") - F.col("neg")).alias("_fp"),
        F.col("all_pos").alias("_pos"),
    )


def pr_curve(df: DataFrame, by: Sequence[str] = (), score="score", label="label", **kw) -> DataFrame:
    """(precision, recall, threshold) for ``score >= threshold`` and the end point."""
    by = list(by)
    curve = curve_table(df, by, score, label, **kw)
    end = curve.groupBy(*by).agg(F.max("all_pos")).select(
        *by,
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return pr_points(curve, by).select(*by, "precision", "recall", "threshold").unionByName(end)


def tune_threshold_from(
    curve: DataFrame, by: Sequence[str] = (), objective: str = "f1", min_recall: float = 0.60
) -> DataFrame:
    """Threshold with the best F1; the lowest one wins ties.  ``recall_priority``
    prefers thresholds that reach ``min_recall``.  The reported metrics are those
    of the strict rule ``score > threshold``."""
    if objective not in ("f1", "recall_priority"):
        raise ValueError(f"Unknown objective: {objective}")
    p, r = F.col("precision"), F.col("recall")
    points = pr_points(curve, by).withColumn("_f1", (2 * p * r) / (p + r + F.lit(1e-12)))
    reached = (r >= min_recall).cast("int") if objective == "recall_priority" else F.lit(1)
    best = points.groupBy(*by).agg(
        F.max_by(
            F.struct("threshold", "_tp", "_fp", "_pos"), F.struct(reached, F.col("_f1"), -F.col("threshold"))
        ).alias("b")
    )
    tp, flagged, actual = F.col("b._tp"), F.col("b._tp") + F.col("b._fp"), F.col("b._pos")
    return best.select(
        *by,
        F.col("b.threshold").alias("threshold"),
        ratio(tp, flagged).alias("precision"),
        ratio(tp, actual).alias("recall"),
        ratio(2 * tp, flagged + actual).alias("f1"),
    )


def tune_threshold(
    df: DataFrame, by: Sequence[str] = (), objective: str = "f1", min_recall: float = 0.60,
    score="score", label="label", **kw,
) -> DataFrame:
    return tune_threshold_from(curve_table(df, by, score, label, **kw), by, objective, min_recall)


def threshold_table_by_f1(df: DataFrame, by: Sequence[str] = (), score="score", label="label", **kw) -> DataFrame:
    """Every threshold with precision, recall and F1, best F1 first."""
    p, r = F.col("precision"), F.col("recall")
    points = pr_points(curve_table(df, by, score, label, **kw), by)
    f1 = (2 * p * r) / F.greatest(p + r, F.lit(1e-9))
    return (
        points.withColumn("f1", f1)
        .select(*by, "threshold", "precision", "recall", "f1")
        .orderBy(*by, F.desc("f1"), F.asc("threshold"))
    )


def evaluate_at(
    df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), score="score", label="label", **kw
) -> DataFrame:
    """Metrics of the inclusive rule ``score >= threshold``, with AUC and AP."""
    by = list(by)
    curve = curve_table(df, by, score, label, **kw)
    above = F.col("score") >= threshold
    sums = curve.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("neg"))), F.lit(0)).alias("fp"),
        F.max("all_pos").alias("p"),
        F.max("all_neg").alias("n"),
        F.sum(F.col("neg") * (F.col("upto_pos") - F.col("pos") / F.lit(2.0))).alias("won"),
        F.sum(
            F.col("pos") * F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg")).cast("double")
        ).alias("steps"),
    )
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    return sums.select(
        *by,
        F.lit(float(threshold)).alias("threshold"),
        ratio(tp + n - fp, p + n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, p).alias("recall"),
        ratio(2 * tp, tp + fp + p).alias("f1"),
        F.when(p * n > 0, F.col("won") / (p * n).cast("double")).alias("roc_auc"),
        F.when(p > 0, F.col("steps") / p.cast("double")).alias("average_precision"),
    )


# ---- calibration and views ---------------------------------------------


def calibrate_fpr(
    df: DataFrame,
    score: str = "score",
    benign: str | None = None,
    target_fpr: float = 0.05,
    unlabeled_quantile: float = 0.95,
) -> DataFrame:
    """One row: threshold, method text and statistics of all scores.

    ``benign`` names a boolean column; without it the quantile is of all scores."""
    if benign is None:
        q, name, pool = unlabeled_quantile, "unlabeled_quantile", df
    else:
        q, name, pool = 1.0 - target_fpr, "benign_quantile", df.where(F.col(benign))
    q = min(max(q, 0.0), 1.0)
    cut = exact_quantiles(pool, [score], [q]).select(F.col(score)[0])
    stats = df.agg(
        F.count(score).alias("sample_count"),
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )
    return stats.select(
        cut.scalar().alias("threshold"), F.lit(f"{name}@{q:.4f}").alias("calibration_method"), "*"
    )


def business_view(df: DataFrame, by: Sequence[str] = (), name: str = "malicious", label="label", pred="pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    counts = df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    percent = {
        "caught_of_100": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fn")) * 100).cast("bigint"),
        "right_of_100": F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fp")) * 100).cast("bigint"),
    }
    return counts.withColumns(percent).withColumn(
        "summary",
        F.format_string(
            f"Out of 100 {name} prompts, the model catches about %d. "
            f"Out of 100 prompts flagged as {name}, about %d are actually {name}. "
            "Confusion counts -> TP: %,d, FN: %,d, FP: %,d, TN: %,d",
            *[F.col(c) for c in ("caught_of_100", "right_of_100", "tp", "fn", "fp", "tn")],
        ),
    )


def latency_stats(df: DataFrame, col: str, by: Sequence[str] = (), runs: int = 1) -> DataFrame:
    """mean, p99, min, max, population std and sample count of a latency column."""
    by = list(by)
    p99 = exact_quantiles(df, [col], [0.99], by).select(*by, F.col(col)[0].alias("p99_ms"))
    stats = df.groupBy(*by).agg(
        F.avg(col).alias("mean_ms"),
        F.min(col).alias("min_ms"),
        F.max(col).alias("max_ms"),
        F.stddev_pop(col).alias("std_ms"),
        F.floor(F.count(col) / F.lit(runs)).alias("n_samples"),
        F.lit(runs).alias("n_runs"),
    )
    return null_safe_join(stats, p99, by)


def leaderboard(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"))


def grid_winner(df: DataFrame, order: str = "run") -> DataFrame:
    """Run with the best (f1, avg_precision); the first in ``order`` wins ties."""
    best = F.max_by(F.struct("*"), F.struct("f1", "avg_precision", -F.col(order)))
    return df.agg(best.alias("w")).select("w.*")


def expected_vs_predicted(df: DataFrame, text_col: str = "prompt", width: int = 70) -> DataFrame:
    text = F.col(text_col)
    return df.select(
        F.concat(F.left(text, F.lit(width)), F.when(F.length(text) > width, "...").otherwise("")).alias("prompt"),
        "expected",
        "predicted",
        F.format_string("%.3f", F.col("confidence")).alias("confidence"),
        "is_ood",
    )
