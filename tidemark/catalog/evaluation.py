"""Evaluation, decision and streaming queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.models import CLASSES, LOGITS, logits, planted_split, trained_on_text
from tidemark.catalog.registry import query
from tidemark.catalog.tables import PLANTED, SCORED, planted, planted_labelled, rounded, scored_documents, table, vectors
from tidemark.functions.vectors import softmax
from tidemark.operators import blocklist, decide, evaluate, tfidf
from tidemark.operators.build import stratified_split
from tidemark.operators.common import windowed
from tidemark.plans.corpus import chat_prompts
from tidemark.plans.scoring import fit_scoring, score_valid_prompts
from tidemark.plans.selection import FOREST_GRID, LOF_GRID, best_detector, candidate_scores, detector_board, grid
from tidemark.session import materialise, scratch_path
from tidemark.sources import writers
from tidemark.streaming.score import read_stream, score_available

BY = ["method"]

# ---- confusion and reports ---------------------------------------------

CONFUSION = SCORED + """, classes AS (
  SELECT method, label AS c FROM scored UNION SELECT method, pred FROM scored),
grid AS (SELECT a.method, a.c AS label, b.c AS pred FROM classes a JOIN classes b ON a.method = b.method),
confusion AS (SELECT g.method, g.label, g.pred, count(s.row_id) AS n FROM grid g
  LEFT JOIN scored s ON s.method = g.method AND s.label = g.label AND s.pred = g.pred GROUP BY ALL)"""

REPORT = SCORED + """, classes AS (
  SELECT method, label AS c FROM scored UNION SELECT method, pred FROM scored),
base AS (SELECT k.method, k.c AS class,
    count(*) FILTER (s.label = k.c AND s.pred = k.c) AS tp,
    count(*) FILTER (s.pred = k.c) AS flagged, count(*) FILTER (s.label = k.c) AS support
  FROM classes k JOIN scored s ON s.method = k.method GROUP BY ALL),
report AS (SELECT *, CASE WHEN flagged = 0 THEN 0.0 ELSE tp / CAST(flagged AS DOUBLE) END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
  CASE WHEN support + flagged = 0 THEN 0.0 ELSE 2 * tp / CAST(support + flagged AS DOUBLE) END AS f1 FROM base)"""


def scored(spark, path):
    return scored_documents(spark, path)


@query("confusion_matrix", f'WITH {CONFUSION} SELECT method, label, pred, n AS "count" FROM confusion')
def _confusion(spark, path):
    return evaluate.confusion_matrix(scored(spark, path), BY)


@query(
    "confusion_normalized",
    f"""WITH {CONFUSION} SELECT method, label, pred, n AS "count",
  round(CASE WHEN sum(n) OVER w = 0 THEN 0.0 ELSE n / CAST(sum(n) OVER w AS DOUBLE) END, 6) AS share
FROM confusion WINDOW w AS (PARTITION BY method, label)""",
)
def _confusion_share(spark, path):
    out = evaluate.confusion_normalized(scored(spark, path), BY)
    return out.withColumn("share", F.round("share", 6))


@query(
    "classification_report",
    f"""WITH {REPORT} SELECT method, CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report
UNION ALL SELECT method, 'accuracy', round(sum(tp) / CAST(sum(support) AS DOUBLE), 6),
  round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), round(sum(tp) / CAST(sum(support) AS DOUBLE), 6),
  CAST(sum(support) AS BIGINT) FROM report GROUP BY method
UNION ALL SELECT method, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM report GROUP BY method
UNION ALL SELECT method, 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM report GROUP BY method""",
)
def _report(spark, path):
    return rounded(evaluate.classification_report(scored(spark, path), BY))


@query(
    "compare_methods",
    f"""WITH {REPORT} SELECT method, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM report GROUP BY method""",
)
def _compare(spark, path):
    return rounded(evaluate.summary_scores(scored(spark, path), BY))


@query(
    "multiclass_report",
    f"""WITH {LOGITS}, s AS (SELECT vec_id, any_value(label) AS label, CAST(arg_max(class, z) AS INTEGER) AS pred
  FROM probs GROUP BY vec_id), classes AS (SELECT label AS c FROM s UNION SELECT pred FROM s)
SELECT CAST(c AS BIGINT) AS class, count(*) FILTER (label = c) AS support,
  round(coalesce(count(*) FILTER (label = c AND pred = c) / CAST(nullif(count(*) FILTER (pred = c), 0) AS DOUBLE), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (label = c AND pred = c) / CAST(nullif(count(*) FILTER (label = c), 0) AS DOUBLE), 0), 6) AS recall
FROM classes CROSS JOIN s GROUP BY c""",
)
def _multiclass(spark, path):
    rows = decide.classify_scores(logits(spark, path), names=None, classes=10)
    out = evaluate.class_scores(rows, pred="predicted_class_id")
    return rounded(out.select("class", "support", "precision", "recall"))


@query(
    "metrics_round_trip",
    f"""WITH {REPORT} SELECT method, CAST(class AS BIGINT) AS class, round(f1, 6) AS f1, support FROM report""",
)
def _metrics_file(spark, path):
    target = scratch_path(spark, "metrics")
    writers.write_metrics_json(evaluate.class_scores(scored(spark, path), BY), target)
    return rounded(writers.read_json(spark, target).select("method", "class", "f1", "support"))


# ---- curves ------------------------------------------------------------

CURVE = SCORED + """, points AS (
  SELECT method, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY ALL),
curve AS (SELECT *, sum(p) OVER w AS up, sum(n) OVER w AS un,
    sum(p) OVER (PARTITION BY method) AS ap, sum(n) OVER (PARTITION BY method) AS an
  FROM points WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
pr AS (SELECT method, score AS threshold, up / CAST(up + un AS DOUBLE) AS precision, up / CAST(ap AS DOUBLE) AS recall,
    CAST(up - p AS DOUBLE) AS tp, CAST(un - n AS DOUBLE) AS fp, CAST(ap AS DOUBLE) AS pos FROM curve)"""
AUC = "sum(n * (up - p / CAST(2 AS DOUBLE))) / CAST(max(ap) * max(an) AS DOUBLE)"
AP = "sum(p * up / CAST(up + un AS DOUBLE)) / CAST(max(ap) AS DOUBLE)"


@query("roc_auc", f"WITH {CURVE} SELECT method, round({AUC}, 6) AS roc_auc FROM curve GROUP BY method")
def _auc(spark, path):
    return rounded(evaluate.roc_auc(scored(spark, path), BY))


@query("average_precision", f"WITH {CURVE} SELECT method, round({AP}, 6) AS average_precision FROM curve GROUP BY method")
def _ap(spark, path):
    return rounded(evaluate.average_precision(scored(spark, path), BY))


@query(
    "roc_auc_ovr",
    f"""WITH {LOGITS}, pts AS (SELECT class, round(p, 9) AS score, count(*) FILTER (label = class) AS p,
    count(*) FILTER (label <> class) AS n FROM probs GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS up FROM pts),
a AS (SELECT CAST(class AS BIGINT) AS class, sum(n * (up - p / CAST(2 AS DOUBLE))) / CAST(sum(p) * sum(n) AS DOUBLE) AS auc
  FROM c GROUP BY class)
SELECT class, round(auc, 6) AS roc_auc, round(avg(auc) OVER (), 6) AS macro FROM a""",
)
def _ovr(spark, path):
    rows = logits(spark, path).withColumn("probs", F.transform(softmax(F.col("logits")), lambda p: F.round(p, 9)))
    return rounded(evaluate.roc_auc_ovr(rows, "probs", "label", CLASSES))


@query(
    "roc_curve_ovr",
    f"""WITH {LOGITS}, pts AS (SELECT CAST(class AS BIGINT) AS class, round(p, 9) AS score, count(*) FILTER (label = class) AS p,
    count(*) FILTER (label <> class) AS n FROM probs GROUP BY ALL),
c AS (SELECT class, score, sum(p) OVER w AS up, sum(n) OVER w AS un, sum(p) OVER (PARTITION BY class) AS ap,
    sum(n) OVER (PARTITION BY class) AS an FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT class, round(un / CAST(an AS DOUBLE), 6) AS fpr, round(up / CAST(ap AS DOUBLE), 6) AS tpr, score AS threshold FROM c
UNION ALL SELECT DISTINCT class, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM c""",
)
def _roc_ovr(spark, path):
    rows = logits(spark, path).withColumn("probs", F.transform(softmax(F.col("logits")), lambda p: F.round(p, 9)))
    curve = evaluate.roc_curve(evaluate.one_vs_rest(rows, "probs", "label", CLASSES), ["class"])
    return rounded(curve, 9).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query(
    "roc_curve",
    f"""WITH {CURVE} SELECT method, round(un / CAST(an AS DOUBLE), 6) AS fpr, round(up / CAST(ap AS DOUBLE), 6) AS tpr,
  score AS threshold FROM curve
UNION ALL SELECT DISTINCT method, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM curve""",
)
def _roc(spark, path):
    return rounded(evaluate.roc_curve(scored(spark, path), BY))


@query(
    "pr_curve",
    f"""WITH {CURVE} SELECT method, round(precision, 6) AS precision, round(recall, 6) AS recall, threshold FROM pr
UNION ALL SELECT DISTINCT method, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE) FROM curve""",
)
def _pr(spark, path):
    return rounded(evaluate.pr_curve(scored(spark, path), BY))


def tuned_sql(reached: str) -> str:
    return f"""WITH {CURVE}, f AS (SELECT *, 2 * precision * recall / (precision + recall + CAST(1e-12 AS DOUBLE)) AS f, {reached} AS ok FROM pr),
best AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ok DESC, f DESC, threshold) AS rn FROM f)
SELECT method, threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / pos, 6) AS recall,
  round(2 * tp / (tp + fp + pos), 6) AS f1 FROM best WHERE rn = 1"""


@query("tune_threshold", tuned_sql("1"))
def _tune(spark, path):
    return rounded(evaluate.tune_threshold(scored(spark, path), BY))


@query("tune_threshold_recall", tuned_sql("CASE WHEN recall >= 0.7 AND recall <= 1 THEN 1 ELSE 0 END"))
def _tune_recall(spark, path):
    return rounded(evaluate.tune_threshold(scored(spark, path), BY, "recall_priority", 0.7))


@query(
    "threshold_table_by_f1",
    f"""WITH {CURVE} SELECT method, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / greatest(precision + recall, CAST(1e-9 AS DOUBLE)), 6) AS f1 FROM pr""",
)
def _f1_table(spark, path):
    return rounded(evaluate.threshold_table_by_f1(scored(spark, path), BY))


@query(
    "evaluate_at",
    f"""WITH {CURVE}, a AS (SELECT method, {AUC} AS auc, {AP} AS ap FROM curve GROUP BY method),
c AS (SELECT method, CAST(count(*) FILTER (label = 1 AND score >= 0.1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (label = 0 AND score >= 0.1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY method)
SELECT c.method, CAST(0.1 AS DOUBLE) AS threshold, round((tp + (n - p) - fp) / n, 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / p, 6) AS recall,
  round(2 * tp / (tp + fp + p), 6) AS f1, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision
FROM c JOIN a ON c.method = a.method""",
)
def _evaluate_at(spark, path):
    return rounded(evaluate.evaluate_at(scored(spark, path), 0.1, BY))


# ---- calibration, views, tables ----------------------------------------


def calibrated_sql(pool: str, q: float, name: str) -> str:
    return f"""SELECT (SELECT round(quantile_cont(value, {q}), 6) FROM events {pool}) AS threshold,
  '{name}@{q:.4f}' AS calibration_method, count(*) AS sample_count, round(avg(value), 6) AS mean_score,
  round(stddev_pop(value), 6) AS std_score, min(value) AS min_score, max(value) AS max_score FROM events"""


@query("calibrate_fpr", calibrated_sql("WHERE event_type = 'view'", 0.95, "benign_quantile"))
def _fpr(spark, path):
    rows = table(spark, path, "events").withColumn("benign", F.col("event_type") == "view")
    return rounded(evaluate.calibrate_fpr(rows, "value", "benign"))


@query("calibrate_unlabeled", calibrated_sql("", 0.95, "unlabeled_quantile"))
def _unlabeled(spark, path):
    return rounded(evaluate.calibrate_fpr(table(spark, path, "events"), "value"))


@query(
    "business_view",
    f"""WITH {SCORED}, c AS (SELECT method, count(*) FILTER (label = 1 AND pred = 1) AS tp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 0 AND pred = 0) AS tn FROM scored GROUP BY method),
s AS (SELECT *, CAST(round_even(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) * 100, 0) AS BIGINT) AS caught_of_100,
  CAST(round_even(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) * 100, 0) AS BIGINT) AS right_of_100 FROM c)
SELECT *, format('Out of 100 malicious prompts, the model catches about {{}}. Out of 100 prompts flagged as malicious, '
  || 'about {{}} are actually malicious. Confusion counts -> TP: {{:,}}, FN: {{:,}}, FP: {{:,}}, TN: {{:,}}',
  caught_of_100, right_of_100, tp, fn, fp, tn) AS summary FROM s""",
)
def _business(spark, path):
    return evaluate.business_view(scored(spark, path), BY)


@query(
    "latency_stats",
    """SELECT event_type, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms,
  round(stddev_pop(value), 6) AS std_ms, CAST(floor(count(value) / 2) AS BIGINT) AS n_samples, CAST(2 AS BIGINT) AS n_runs,
  round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events GROUP BY event_type""",
)
def _latency(spark, path):
    return rounded(evaluate.latency_stats(table(spark, path, "events"), "value", ["event_type"], 2))


BOARD = f"""{REPORT}, board AS (SELECT method AS model, f1, recall, precision FROM report WHERE class = 1)"""


def board(spark, path):
    return evaluate.class_scores(scored(spark, path), BY).where("class = 1").select(
        F.col("method").alias("model"), "f1", "recall", "precision"
    )


@query(
    "leaderboard",
    f"""WITH {BOARD} SELECT model, round(f1, 6) AS f1, round(recall, 6) AS recall, round(precision, 6) AS precision,
  row_number() OVER (ORDER BY f1 DESC, recall DESC, precision DESC) AS place FROM board""",
)
def _leaderboard(spark, path):
    ranked = evaluate.leaderboard(board(spark, path))
    place = F.row_number().over(windowed([], F.desc("f1"), F.desc("recall"), F.desc("precision")))
    return rounded(ranked.withColumn("place", place))


@query(
    "grid_winner",
    f"""WITH {CURVE}, a AS (SELECT method, {AP} AS ap FROM curve GROUP BY method),
f AS (SELECT method, max(2 * precision * recall / (precision + recall + CAST(1e-12 AS DOUBLE))) AS f1 FROM pr GROUP BY method)
SELECT f.method, round(f1, 6) AS f1, round(ap, 6) AS avg_precision FROM f JOIN a ON f.method = a.method
ORDER BY f1 DESC, ap DESC LIMIT 1""",
)
def _winner(spark, path):
    curve = evaluate.curve_table(scored(spark, path), BY)
    p, r = F.col("precision"), F.col("recall")
    best = evaluate.pr_points(curve, BY).groupBy(*BY).agg(F.max(2 * p * r / (p + r + F.lit(1e-12))).alias("f1"))
    ap = evaluate.average_precision_from(curve, BY).withColumnRenamed("average_precision", "avg_precision")
    runs = best.join(ap, BY).withColumn("run", F.crc32(F.col("method").cast("binary")))
    return rounded(evaluate.grid_winner(runs).drop("run"))


# ---- classification of the planted prompts, as decision input ----------

RISKY = """CASE WHEN t LIKE '%ignore%' OR t LIKE '%malware%' THEN 'Malicious' WHEN t LIKE '%dance%' THEN 'unsafe'
  WHEN t LIKE '%code%' THEN 'needs review' WHEN t LIKE '%secret%' THEN 'Prompt Injection' ELSE 'Benign' END"""
SIGNALS = (
    PLANTED
    + f""", texts AS (SELECT row_id, prompt, lower(prompt) AS t, length(prompt) AS n FROM planted),
signals AS (SELECT row_id AS prompt_id, prompt, CAST(n % 1000 AS DOUBLE) / 1000.0::DOUBLE AS anomaly_score,
    CAST(0.5 AS DOUBLE) AS threshold, n % 1000 >= 500 AS is_anomalous, {RISKY} AS predicted_label,
    CAST(n % 97 AS DOUBLE) / 97.0::DOUBLE AS confidence, CAST(0.6 AS DOUBLE) AS min_confidence,
    (CAST(n % 97 AS DOUBLE) / 97.0::DOUBLE < 0.6) <> (n % 11 = 0) AS is_uncertain FROM texts),
hints AS (SELECT *, lower(trim(predicted_label)) AS l, anomaly_score - threshold AS margin,
    confidence >= min_confidence AND NOT is_uncertain AS sure FROM signals),
flags AS (SELECT *, contains(l, 'malicious') OR contains(l, 'attack') OR contains(l, 'inject') OR contains(l, 'unsafe') AS bad,
    contains(l, 'benign') OR contains(l, 'safe') OR contains(l, 'normal') AS good FROM hints),
risk AS (SELECT *, CASE WHEN is_anomalous THEN 2 ELSE 0 END + CASE WHEN margin >= 0.25 THEN 1 ELSE 0 END
    + CASE WHEN bad AND sure THEN 3 WHEN bad THEN 1 ELSE 0 END + CASE WHEN good AND sure THEN -2 ELSE 0 END
    + CASE WHEN is_anomalous AND (is_uncertain OR bad) THEN 1 ELSE 0 END AS risk_score,
  concat_ws(' | ',
    CASE WHEN is_anomalous THEN printf('anomaly_score_above_threshold (%.4f >= %.4f)', anomaly_score, threshold)
         ELSE printf('anomaly_score_below_threshold (%.4f < %.4f)', anomaly_score, threshold) END,
    CASE WHEN margin >= 0.25 THEN printf('anomaly_margin_high (%.4f)', margin) END,
    CASE WHEN bad AND sure THEN printf('classifier_predicted_malicious_with_confidence (%s, confidence=%.4f)', predicted_label, confidence)
         WHEN bad THEN printf('classifier_predicted_malicious_but_low_confidence (%s, confidence=%.4f)', predicted_label, confidence) END,
    CASE WHEN good AND sure THEN printf('classifier_predicted_benign_with_confidence (%s, confidence=%.4f)', predicted_label, confidence)
         WHEN is_uncertain THEN printf('classifier_uncertain (confidence=%.4f, min_confidence=%.4f)', confidence, min_confidence) END,
    CASE WHEN is_anomalous AND (is_uncertain OR bad) THEN 'cross_signal_agreement_on_risk' END) AS reasons FROM flags),
verdicts AS (SELECT *, CASE WHEN risk_score >= 2 THEN 'malicious' ELSE 'benign' END AS final_label,
    risk_score >= 2 AS is_malicious FROM risk)"""
)


def signals(spark, path):
    """Stand-in scores from each text's length and words: all branches occur."""
    t, n = F.lower("prompt"), F.length("prompt")
    has = lambda w: F.contains(t, F.lit(w))
    label = (
        F.when(has("ignore") | has("malware"), "Malicious").when(has("dance"), "unsafe")
        .when(has("code"), "needs review").when(has("secret"), "Prompt Injection").otherwise("Benign")
    )
    confidence = (n % 97).cast("double") / F.lit(97.0)
    return planted(spark, path).select(
        F.col("row_id").alias("prompt_id"),
        "prompt",
        ((n % 1000).cast("double") / F.lit(1000.0)).alias("anomaly_score"),
        F.lit(0.5).alias("threshold"),
        (n % 1000 >= 500).alias("is_anomalous"),
        label.alias("predicted_label"),
        confidence.alias("confidence"),
        F.lit(0.6).alias("min_confidence"),
        ((confidence < F.lit(0.6)) != (n % 11 == 0)).alias("is_uncertain"),
    )


@query(
    "decide_prompt_risk",
    f"WITH {SIGNALS} SELECT prompt_id, CAST(risk_score AS BIGINT) AS risk_score, final_label, is_malicious, reasons FROM verdicts",
)
def _decide(spark, path):
    out = decide.decide_prompt_risk(signals(spark, path))
    return out.select(
        "prompt_id", F.col("risk_score").cast("bigint").alias("risk_score"), "final_label", "is_malicious",
        F.array_join("reasons", " | ").alias("reasons"),
    )


@query(
    "triage_tone",
    f"""WITH {SIGNALS}, tones AS (SELECT
  CASE WHEN is_uncertain THEN 'warn'
       WHEN contains(l, 'mal') OR contains(l, 'attack') OR contains(l, 'inject') OR contains(l, 'unsafe') THEN 'bad'
       WHEN good THEN 'ok' ELSE 'neutral' END AS class_tone,
  CASE WHEN is_malicious THEN 'bad' WHEN is_uncertain OR contains(final_label, 'review') OR contains(reasons, 'uncertain')
       THEN 'warn' ELSE 'ok' END AS final_tone, prompt_id FROM verdicts)
SELECT prompt_id, class_tone, final_tone FROM tones""",
)
def _tone(spark, path):
    out = decide.triage_tone(decide.decide_prompt_risk(signals(spark, path)))
    return out.select("prompt_id", "class_tone", "final_tone")


@query(
    "allow_flag_block",
    f"""WITH {SIGNALS} SELECT CASE WHEN is_anomalous THEN 'FLAG' WHEN predicted_label = 'Benign' THEN 'ALLOW' ELSE 'BLOCK' END AS action,
  predicted_label, count(*) AS rows FROM signals GROUP BY ALL""",
)
def _action(spark, path):
    rows = signals(spark, path).withColumnRenamed("is_anomalous", "is_ood")
    return decide.allow_flag_block(rows).groupBy("action", "predicted_label").agg(F.count("*").alias("rows"))


@query(
    "expected_vs_predicted",
    f"""WITH {SIGNALS} SELECT CASE WHEN length(prompt) > 70 THEN left(prompt, 70) || '...' ELSE prompt END AS prompt,
  CASE WHEN prompt_id % 12 = 0 THEN 'Benign' ELSE 'Malicious' END AS expected, predicted_label AS predicted,
  printf('%.3f', confidence) AS confidence, is_anomalous AS is_ood FROM signals""",
)
def _expected(spark, path):
    rows = signals(spark, path).select(
        "prompt",
        F.when(F.pmod("prompt_id", F.lit(12)) == 0, "Benign").otherwise("Malicious").alias("expected"),
        F.col("predicted_label").alias("predicted"),
        "confidence",
        F.col("is_anomalous").alias("is_ood"),
    )
    return evaluate.expected_vs_predicted(rows)


HALVES = """docs AS (SELECT doc_id AS prompt_id, text AS prompt FROM documents),
turns AS (SELECT d.doc_id AS prompt_id, CASE WHEN l.quality = 0 THEN d.text || ' ' ELSE d.text END AS prompt
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def halves(spark, path):
    """Anomaly rows for all documents, classification rows for the labelled ones,
    of which the low-quality ones name another prompt."""
    docs = table(spark, path, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    labels = table(spark, path, "labels").select(F.col("doc_id").alias("prompt_id"), "quality")
    changed = F.when(F.col("quality") == 0, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt"))
    anomaly = docs.withColumn("anomaly_score", F.length("prompt") / F.lit(1000.0))
    classes = docs.join(labels, "prompt_id").select("prompt_id", changed.alias("prompt"), F.lit("Benign").alias("predicted_label"))
    return decide.join_signals(anomaly, classes)


@query(
    "join_signals",
    f"""WITH {HALVES} SELECT d.prompt_id, length(d.prompt) / 1000.0::DOUBLE AS anomaly_score, 'Benign' AS predicted_label
FROM docs d JOIN turns t ON d.prompt_id = t.prompt_id AND d.prompt = t.prompt""",
)
def _join(spark, path):
    return halves(spark, path)[0].select("prompt_id", "anomaly_score", "predicted_label")


@query(
    "rejected_signals",
    f"""WITH {HALVES} SELECT coalesce(d.prompt_id, t.prompt_id) AS prompt_id, CASE WHEN d.prompt_id IS NULL THEN 'anomaly_missing'
  WHEN t.prompt_id IS NULL THEN 'classification_missing' ELSE 'prompt_mismatch' END AS reject_reason
FROM docs d FULL JOIN turns t ON d.prompt_id = t.prompt_id WHERE d.prompt IS DISTINCT FROM t.prompt""",
)
def _rejects(spark, path):
    return halves(spark, path)[1]


# ---- detector search ---------------------------------------------------


def detector_scores(spark, path):
    """Class 0 of the vectors is novel; the others are split into training and
    validation rows."""
    rows = stratified_split(vectors(spark, path), "vec_id", {"train": 0.6, "val": 0.4}, ["label"])
    train = rows.where("split = 'train' AND label <> 0")
    novel = (F.col("label") == 0).cast("int")
    val = rows.where("split = 'val' OR label = 0").withColumn("label", novel)
    return candidate_scores(train, val, "vec_id", "embedding", grid(FOREST_GRID), grid(LOF_GRID))


BOARDS: dict[tuple[str, str], DataFrame] = {}


def stored_board(spark, path):
    """The board of all runs, computed once a session and written to the shared folder."""
    key = (spark.sparkContext.applicationId, path)
    if key not in BOARDS:
        BOARDS[key] = materialise(detector_board(detector_scores(spark, path)))
    return BOARDS[key]


@query("detector_board")
def _board(spark, path):
    return rounded(stored_board(spark, path))


@query("best_detector")
def _best(spark, path):
    return rounded(best_detector(stored_board(spark, path)))


# ---- end to end --------------------------------------------------------


def scoring_model(spark, path):
    return fit_scoring(planted_labelled(spark, path).select("prompt", "label"))


def compact(df):
    return df.select(
        "prompt_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomalous", "predicted_label",
        F.round("confidence", 6).alias("confidence"), "final_label", F.size("reasons").alias("n_reasons"), "reject_reason",
    )


@query("score_prompts")
def _score(spark, path):
    rows = planted(spark, path).select(F.col("row_id").alias("prompt_id"), "prompt")
    return compact(score_valid_prompts(rows, scoring_model(spark, path)))


@query("stream_score")
def _stream(spark, path):
    model = scoring_model(spark, path)
    schema = table(spark, path, "conversations").schema
    stream = read_stream(spark, f"{path}/conversations*.parquet", schema)
    return compact(score_available(stream, lambda df: score_valid_prompts(chat_prompts(df), model)))


@query(
    "chat_prompts",
    "SELECT conv_id || ':' || turn AS prompt_id, text AS prompt FROM conversations WHERE role = 'user'",
)
def _chat(spark, path):
    return chat_prompts(table(spark, path, "conversations"))


@query("compare_classifiers")
def _classifiers(spark, path):
    """Blocklist, TF-IDF SVM and text classifier on the same held-out split, one metric row each."""
    parts = materialise(planted_split(spark, path).select("row_id", "prompt", "label", "split"))
    test = parts.where("split = 'test'")
    svm = tfidf.fit_tfidf_svm(parts.where("split = 'train'"))
    judged = trained_on_text(parts).score(test).withColumn("pred", (F.col("margin") > 0).cast("int"))
    rows = [("keyword_blocklist", blocklist.keyword_blocklist(test)), ("tfidf_svm", svm.predict(test)), ("text_classifier", judged)]
    told = [df.select(F.lit(name).alias("method"), "label", "pred") for name, df in rows]
    return rounded(evaluate.summary_scores(reduce(DataFrame.unionByName, told), BY))
