"""Rule, text-model and anomaly queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog.features import NUMERIC, features, quoted_pattern
from tidemark.catalog.registry import query
from tidemark.catalog.tables import (
    PLANTED, PROMPTS, VECTORS, planted, planted_labelled, prompts, rounded, table, vectors,
)
from tidemark.functions.rules import BLOCKLIST
from tidemark.functions.vectors import softmax
from tidemark.operators import anomaly, blocklist, decide, forest, matrix, models, neighbours, network, text_model, tfidf
from tidemark.operators.build import stratified_split
from tidemark.session import materialise, scratch_path

# ---- rules -------------------------------------------------------------

PATTERNS = [(f"{family}_{i + 1}", p) for family, group in BLOCKLIST.items() for i, p in enumerate(group)]
ANY = quoted_pattern("|".join(f"(?:{p})" for _, p in PATTERNS))


@query(
    "keyword_blocklist",
    f"WITH {PLANTED} SELECT row_id, CASE WHEN regexp_matches(lower(prompt), {ANY}) THEN 1 ELSE 0 END AS pred FROM planted",
)
def _blocklist(spark, path):
    return blocklist.keyword_blocklist(planted(spark, path).select("row_id", "prompt")).drop("prompt")


@query(
    "blocklist_hits",
    f"WITH {PLANTED}, m AS ("
    + " UNION ALL ".join(
        f"SELECT row_id, '{name}' AS hit FROM planted WHERE regexp_matches(lower(prompt), {quoted_pattern(p)})"
        for name, p in PATTERNS
    )
    + ") SELECT hit, count(*) AS rows, CAST(sum(row_id) AS BIGINT) AS id_sum FROM m GROUP BY hit",
)
def _hits(spark, path):
    found = blocklist.blocklist_hits(planted(spark, path).select("row_id", "prompt"))
    pairs = found.select("row_id", F.explode_outer("hits").alias("hit")).where("hit IS NOT NULL")
    return pairs.groupBy("hit").agg(F.count("*").alias("rows"), F.sum("row_id").alias("id_sum"))


# ---- tf-idf ------------------------------------------------------------

MAX_TERMS = 10_000


@query(
    "tfidf_top",
    rf"""WITH {PROMPTS}, tok AS (
  SELECT row_id, unnest(words) AS a, unnest(range(len(words))) AS pos FROM (
    SELECT row_id, regexp_extract_all(strip_accents(lower(prompt)), '[\p{{L}}\p{{N}}_]{{2,}}') AS words FROM prompts)),
grams AS (SELECT row_id, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM tok
  WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
terms AS (SELECT row_id, a AS term FROM grams
  UNION ALL SELECT row_id, a || ' ' || b FROM grams WHERE b IS NOT NULL
  UNION ALL SELECT row_id, a || ' ' || b || ' ' || c FROM grams WHERE c IS NOT NULL),
vocab AS (SELECT term, count(*) AS corpus_count, count(DISTINCT row_id) AS df FROM terms
  GROUP BY term ORDER BY corpus_count DESC, term LIMIT {MAX_TERMS}),
n AS (SELECT count(*) AS docs FROM prompts),
tf AS (SELECT row_id, t.term, count(*) AS tf FROM terms t JOIN vocab v ON t.term = v.term GROUP BY row_id, t.term),
raw AS (SELECT row_id, tf.term, (1 + ln(tf)) * (ln((1 + docs) / CAST(1 + df AS DOUBLE)) + 1) AS w
  FROM tf JOIN vocab v ON tf.term = v.term CROSS JOIN n),
unit AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM raw)
SELECT term, count(*) AS documents, round(sum(weight), 4) AS weight FROM unit GROUP BY term""",
)
def _tfidf(spark, path):
    rows = prompts(spark, path).select("row_id", "prompt")
    model = tfidf.fit_tfidf(rows, max_features=MAX_TERMS)
    weights = tfidf.tfidf_terms(rows, model, "row_id")
    return weights.groupBy("term").agg(
        F.count("*").alias("documents"), F.round(F.sum("weight"), 4).alias("weight")
    )


def planted_split(spark, path):
    """Planted prompts of the labelled documents; label = an attack was planted
    (endings 1 to 8 and 11), split 70/15/15."""
    rows = planted_labelled(spark, path)
    attack = (F.pmod("row_id", F.lit(12)).between(1, 8) | (F.pmod("row_id", F.lit(12)) == 11)).cast("int")
    return stratified_split(rows.withColumn("label", attack))


@query("tfidf_svm")
def _svm(spark, path):
    parts = planted_split(spark, path)
    model = tfidf.fit_tfidf_svm(parts.where("split = 'train'"))
    return model.predict(parts.where("split = 'test'").select("row_id", "prompt", "label")).drop("prompt")


def trained_on_text(parts):
    return text_model.fit_hashed_classifier(*[parts.where(F.col("split") == s) for s in ("train", "val")])


@query("text_classifier")
def _classifier(spark, path):
    """Held-out prompts by the classifier trained on the text."""
    parts = materialise(planted_split(spark, path).select("row_id", "prompt", "label", "split"))
    model = trained_on_text(parts)
    scored = model.score(parts.where("split = 'test'"))
    judged = decide.classify_scores(scored.withColumn("logits", model.logits(F.col("margin"))))
    return judged.select("row_id", "label", "predicted_label", F.round("confidence", 6).alias("confidence"))


@query("mlp_batch_predict")
def _mlp(spark, path):
    rows = features(spark, path)
    scaled = matrix.fit_standard(rows, NUMERIC).apply(rows.select("row_id", "label", *NUMERIC))
    net = models.fit_mlp(scaled, NUMERIC, hidden=((16, 8, 4),), max_iter=15)
    return models.batch_predict(scaled, net, NUMERIC).select("row_id", "label", "pred", F.round("score", 6).alias("score"))


# ---- class scores ------------------------------------------------------

CLASSES = tuple(range(10))


def logits(spark, path):
    """First ten embedding values times ten, as the logits of ten classes."""
    rows = vectors(spark, path)
    return rows.select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x * F.lit(10.0)).alias("logits"))


LOGITS = VECTORS + """, flat AS (
  SELECT vec_id, label, unnest(embedding[1:10]) * CAST(10.0 AS DOUBLE) AS z, unnest(range(10)) AS class FROM vectors),
probs AS (SELECT vec_id, label, class, z, exp(z - max(z) OVER (PARTITION BY vec_id))
    / sum(exp(z)) OVER (PARTITION BY vec_id) * exp(max(z) OVER (PARTITION BY vec_id)) AS p FROM flat)"""


@query(
    "classify_scores",
    f"""WITH {LOGITS} SELECT vec_id, CAST(arg_max(class, z) AS INTEGER) AS predicted_class_id,
  'class_' || arg_max(class, z) AS predicted_label, round(arg_max(p, z), 6) AS confidence,
  round(max(p) FILTER (class = 3), 6) AS probability_3, arg_max(p, z) < CAST(0.5 AS DOUBLE) AS is_uncertain
FROM probs GROUP BY vec_id""",
)
def _scores(spark, path):
    out = decide.classify_scores(logits(spark, path), names=None, classes=10, min_confidence=0.5)
    return out.select(
        "vec_id", "predicted_class_id", "predicted_label", F.round("confidence", 6).alias("confidence"),
        F.round(F.col("class_probabilities")["class_3"], 6).alias("probability_3"), "is_uncertain",
    )


@query("msp_score", f"WITH {LOGITS} SELECT vec_id, round(1 - max(p), 6) AS msp FROM probs GROUP BY vec_id")
def _msp(spark, path):
    rows = logits(spark, path).withColumn("probs", softmax(F.col("logits")))
    return rows.select("vec_id", F.round(anomaly.msp_score(F.col("probs")), 6).alias("msp"))


# ---- Mahalanobis -------------------------------------------------------

LONG = VECTORS + """, long AS (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM vectors),
means AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM long GROUP BY label, i)"""


@query("class_means", f"WITH {LONG} SELECT label, i, n AS rows, round(m, 6) AS mean FROM means")
def _means(spark, path):
    rows = anomaly.class_means(vectors(spark, path))
    flat = rows.select("label", "rows", F.posexplode("mean").alias("i", "mean"))
    return flat.select("label", F.col("i").cast("bigint").alias("i"), "rows", F.round("mean", 6).alias("mean"))


@query(
    "pooled_covariance",
    f"""WITH {LONG}, away AS (SELECT vec_id, l.i, x - m AS d FROM long l JOIN means s ON l.label = s.label AND l.i = s.i)
SELECT a.i AS i, b.i AS j, round(sum(a.d * b.d) / ((SELECT count(*) FROM vectors) - 1), 6) AS covariance
FROM away a JOIN away b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
)
def _covariance(spark, path):
    _, pooled = anomaly.pooled_covariance(vectors(spark, path))
    d = len(pooled)
    rows = [(i, j, float(pooled[i, j])) for i in range(d) for j in range(i, d)]
    return rounded(spark.createDataFrame(rows, "i bigint, j bigint, covariance double"))


def plane(spark, path):
    rows = vectors(spark, path)
    return rows.select("vec_id", "label", F.slice("embedding", 1, 2).alias("embedding"))


PLANE = VECTORS + """, plane AS (SELECT vec_id, label, embedding[1] AS x, embedding[2] AS y FROM vectors),
centres AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM plane GROUP BY label),
away AS (SELECT x - mx AS dx, y - my AS dy FROM plane p JOIN centres c ON p.label = c.label),
cov AS (SELECT sum(dx * dx) / (count(*) - 1) + 1e-6::DOUBLE AS a, sum(dx * dy) / (count(*) - 1) AS b,
  sum(dy * dy) / (count(*) - 1) + 1e-6::DOUBLE AS c FROM away),
distances AS (SELECT vec_id, p.label, min(((x - mx) * (x - mx) * c - 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * a)
    / (a * c - b * b)) AS ood_score FROM plane p CROSS JOIN centres k CROSS JOIN cov GROUP BY vec_id, p.label),
cut AS (SELECT quantile_cont(ood_score, 0.95) AS threshold FROM distances)"""


def plane_scores(spark, path):
    rows = plane(spark, path)
    return anomaly.fit_mahalanobis(rows, components=None).score(rows)


@query("mahalanobis_2d", f"WITH {PLANE} SELECT vec_id, round(ood_score, 5) AS ood_score FROM distances")
def _maha2(spark, path):
    return rounded(plane_scores(spark, path).select("vec_id", "ood_score"), 5)


@query(
    "calibrate_threshold",
    f"WITH {PLANE} SELECT round(threshold, 5) AS threshold, (SELECT count(*) FROM distances) AS rows FROM cut",
)
def _calibrate(spark, path):
    scores = plane_scores(spark, path)
    limit = anomaly.calibrate_threshold(scores)
    return scores.agg(F.round(F.lit(limit), 5).alias("threshold"), F.count("*").alias("rows"))


@query(
    "predict_ood",
    f"""WITH {PLANE} SELECT label, count(*) AS rows, count(*) FILTER (ood_score > threshold) AS ood
FROM distances CROSS JOIN cut GROUP BY label""",
)
def _predict_ood(spark, path):
    scores = plane_scores(spark, path)
    flagged = anomaly.predict_ood(scores, anomaly.calibrate_threshold(scores))
    return flagged.groupBy("label").agg(F.count("*").alias("rows"), F.count_if("is_ood").alias("ood"))


@query("mahalanobis_pca")
def _maha(spark, path):
    rows = vectors(spark, path)
    model = anomaly.fit_mahalanobis(rows, components=32)
    return model.score(rows).select("vec_id", F.round("ood_score", 6).alias("ood_score"))


# ---- reconstruction ----------------------------------------------------

PAIRS = VECTORS + """, cells AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(list_reverse(embedding)) AS y FROM vectors),
errors AS (SELECT vec_id, sum((x - y) * (x - y)) / count(*) AS recon_mse, max(abs(x - y)) AS recon_max_abs
  FROM cells GROUP BY vec_id)"""


def mirrored(spark, path):
    """Each vector and its reversal as the stand-in reconstruction."""
    rows = vectors(spark, path)
    return anomaly.reconstruction_errors(
        rows.select("vec_id", F.col("embedding").alias("x"), F.reverse("embedding").alias("xhat"))
    ).drop("x", "xhat")


@query(
    "reconstruction_errors",
    f"WITH {PAIRS} SELECT vec_id, round(recon_mse, 6) AS recon_mse, round(recon_max_abs, 6) AS recon_max_abs FROM errors",
)
def _errors(spark, path):
    return rounded(mirrored(spark, path))


@query(
    "hybrid_score",
    f"""WITH {PAIRS}, med AS (SELECT quantile_cont(recon_mse, 0.5) AS m1, quantile_cont(recon_max_abs, 0.5) AS m2 FROM errors),
mad AS (SELECT quantile_cont(abs(recon_mse - m1), 0.5) AS d1, quantile_cont(abs(recon_max_abs - m2), 0.5) AS d2
  FROM errors CROSS JOIN med)
SELECT vec_id, round(CAST(0.7 AS DOUBLE) * 0.6745 * (recon_mse - m1) / (d1 + 1e-9)
  + CAST(0.3 AS DOUBLE) * 0.6745 * (recon_max_abs - m2) / (d2 + 1e-9), 5) AS hybrid_score
FROM errors CROSS JOIN med CROSS JOIN mad""",
)
def _hybrid(spark, path):
    return rounded(anomaly.hybrid_score(mirrored(spark, path)).select("vec_id", "hybrid_score"), 5)


@query(
    "robust_zscore",
    """WITH med AS (SELECT quantile_cont(value, 0.5) AS m FROM events),
mad AS (SELECT quantile_cont(abs(value - m), 0.5) AS d FROM events CROSS JOIN med)
SELECT event_id, round(CAST(0.6745 AS DOUBLE) * (value - m) / (d + 1e-9), 5) AS z
FROM events CROSS JOIN med CROSS JOIN mad""",
)
def _robust_z(spark, path):
    rows = table(spark, path, "events").select("event_id", "value")
    return rows.select("event_id", F.round(anomaly.fit_robust_z(rows, "value").apply(F.col("value")), 5).alias("z"))


@query(
    "anomaly_decision",
    f"""WITH {PAIRS} SELECT vec_id, round(recon_mse, 6) >= 0.03 AS is_anomalous,
  CASE WHEN round(recon_mse, 6) >= 0.03 THEN 'malicious_or_anomalous' ELSE 'benign_like' END AS decision_label,
  CAST(0.03 AS DOUBLE) AS threshold, 'reconstruction_mse' AS score_name FROM errors""",
)
def _decision(spark, path):
    rows = rounded(mirrored(spark, path)).select("vec_id", F.col("recon_mse").alias("anomaly_score"))
    judged = decide.anomaly_decision(rows, threshold=0.03)
    return judged.select("vec_id", "is_anomalous", "decision_label", "threshold", "score_name")


@query("reconstruct_linear")
def _linear(spark, path):
    rows = vectors(spark, path).withColumnRenamed("embedding", "x")
    coded = anomaly.reconstruct_linear(rows, matrix.fit_pca(rows, "x", 12))
    return rounded(anomaly.reconstruction_errors(coded).select("vec_id", "recon_mse", "recon_max_abs"))


@query("reconstruct_network")
def _network(spark, path):
    """A network whose weights, fitted on the vectors, stand in a table of the scratch folder."""
    rows = vectors(spark, path).withColumnRenamed("embedding", "x")
    values, layout = network.network_tables(spark, network.coder_of(matrix.fit_pca(rows, "x", 12)))
    place = scratch_path(spark, "network")
    values.write.parquet(place)
    coded = anomaly.reconstruct(rows, network.load_network(spark.read.schema(network.VALUES).parquet(place), layout))
    return rounded(anomaly.reconstruction_errors(coded).select("vec_id", "recon_mse", "recon_max_abs"))


# ---- detectors ---------------------------------------------------------


@query("isolation_forest")
def _forest(spark, path):
    rows = vectors(spark, path)
    model = forest.fit_isolation_forest(rows, "vec_id", "embedding", trees=50, max_features=0.8)
    return model.score(rows, "embedding").select("vec_id", F.round("if_score", 6).alias("if_score"))


@query(
    "lof_exact",
    f"""WITH {VECTORS}, d AS (SELECT a.vec_id AS a, b.vec_id AS b,
    sqrt(greatest(0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS dist
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM d),
nn AS (SELECT * FROM r WHERE rn <= 15),
kd AS (SELECT a, max(dist) AS k FROM nn GROUP BY a),
lrd AS (SELECT nn.a, 1 / (avg(greatest(dist, kd.k)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.b = kd.a GROUP BY nn.a)
SELECT nn.a AS vec_id, round(avg(o.lrd) / any_value(s.lrd), 4) AS lof
FROM nn JOIN lrd o ON nn.b = o.a JOIN lrd s ON nn.a = s.a GROUP BY nn.a""",
)
def _lof(spark, path):
    _, factors = neighbours.fit_lof(vectors(spark, path), "vec_id", "embedding", k=15)
    return rounded(factors, 4)


@query("lof_novelty")
def _novelty(spark, path):
    rows = vectors(spark, path)
    model, _ = neighbours.fit_lof(rows.where("label <> 0"), "vec_id", "embedding", k=15, p=1, contamination=0.03)
    return model.score(rows, "embedding").select("vec_id", F.round("lof_score", 6).alias("lof_score"))


