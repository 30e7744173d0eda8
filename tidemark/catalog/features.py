"""Text features, embeddings and feature-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tables import (
    PLANTED, PLANTED_LABELLED, PROMPTS, VECTORS, planted, planted_labelled, prompts, rounded, strip_sql, table,
    vectors,
)
from tidemark.functions import text as X
from tidemark.functions.features import (
    SERVE_FEATURES, TRAIN_FEATURES, feature_skew, phrase_score, text_features,
)
from tidemark.functions.rules import PHRASE_RULES
from tidemark.operators import matrix
from tidemark.operators.build import encode_sources
from tidemark.plans.corpus import engineered_table
from tidemark.session import materialise

# ---- the feature definitions as SQL ------------------------------------

TRAIN_TEXT = strip_sql("replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
SERVE_TEXT = (
    r"left(regexp_replace(regexp_replace("
    + strip_sql("replace(replace(coalesce({0}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")
    + r", '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), 20000)"
)
PUNCT = r"[!-/:-@\[-`{-~]"


def dropped(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, {quoted_pattern(pattern)}, '', 'g')))"


def quoted_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WORDS = r"len(regexp_extract_all(t, '\S+'))"
SIZE = "CAST(greatest(length(t), 1) AS DOUBLE)"
REPEATED = r"len(regexp_extract_all(t, '!{2,}|\?{2,}|\.{2,}|,{2,}|:{2,}|;{2,}'))"


def score_sql(group: str) -> str:
    return "(" + " + ".join(
        f"CAST(contains(lower(t), {quoted_pattern(p)}) AS BIGINT)" for p in PHRASE_RULES[group]
    ) + ")"


def feature_sql(serve: bool) -> dict[str, str]:
    blank = r"\s"
    tokens_per_word = f"CASE WHEN {WORDS} = 0 THEN 0.0 ELSE {WORDS} / CAST({WORDS} AS DOUBLE) END"
    out = {
        "char_length": "length(t)",
        "word_count": WORDS,
        "avg_word_length": f"CASE WHEN {WORDS} = 0 THEN 0.0 ELSE (length(t) - {dropped(blank)}) / CAST({WORDS} AS DOUBLE) END",
        "line_count": f"{dropped(chr(10))} + 1",
        "sentence_count": dropped("[.!?]"),
        "token_count": WORDS,
        "token_word_ratio": tokens_per_word,
        "token_char_ratio": f"{WORDS} / {SIZE}",
        **{f"over_{k}_tokens": f"CAST({WORDS} > {k} AS BIGINT)" for k in (128, 256, 512)},
        "uppercase_ratio": f"{dropped(chr(92) + 'p{Lu}')} / {SIZE}",
        "digit_ratio": f"{dropped(chr(92) + 'p{Nd}')} / {SIZE}",
        "whitespace_count": dropped(blank),
        "whitespace_ratio": f"{dropped(blank)} / {SIZE}",
        "punctuation_count": dropped(PUNCT),
        "punctuation_ratio": f"{dropped(PUNCT)} / {SIZE}",
        "special_char_ratio": f"{dropped(r'[^\p{L}\p{N}\s]')} / {SIZE}",
        "non_ascii_count": dropped(r"[^\x00-\x7F]"),
        "non_ascii_ratio": f"{dropped(r'[^\x00-\x7F]')} / {SIZE}",
        "newline_count": dropped(chr(10)),
        "markdown_symbol_count": dropped(r"[#*`>_\-\[\]()]" if serve else "[`*_#>-]"),
        "has_code_block": "CAST(contains(t, '```') AS BIGINT)",
        "repeated_punct_count": REPEATED,
        "quote_count": dropped("[\"']"),
        "bracket_count": dropped(r"[()\[\]{}<>]" if serve else r"[()\[\]{}]"),
        "colon_count": dropped(":"),
        "semicolon_count": dropped(";"),
    }
    for group in PHRASE_RULES:
        out[f"{group}_score"] = score_sql(group)
        out[f"has_{group}"] = f"CAST({score_sql(group)} > 0 AS BIGINT)"
    return out


def select_features_sql(serve: bool) -> str:
    exprs = feature_sql(serve)
    names = SERVE_FEATURES if serve else TRAIN_FEATURES
    parts = []
    for n in names:
        ratio = n.endswith("_ratio") or n == "avg_word_length"
        parts.append(
            f"round(CAST({exprs[n]} AS DOUBLE), 6) AS {n}" if ratio or serve else f"CAST({exprs[n]} AS BIGINT) AS {n}"
        )
    return ", ".join(parts)


TRAIN_SQL = f"""{PLANTED_LABELLED}, texts AS (SELECT row_id, source_dataset, label,
  {TRAIN_TEXT.format('prompt')} AS t FROM planted_labelled),
feats AS (SELECT row_id, source_dataset, label, {select_features_sql(False)} FROM texts)"""


@query(
    "features_by_label",
    f"""WITH {PROMPTS}, texts AS (SELECT label, {TRAIN_TEXT.format('prompt')} AS t FROM prompts),
feats AS (SELECT label, {select_features_sql(False)} FROM texts)
SELECT label, count(*) AS rows, {", ".join(f"round(avg({c}), 5) AS {c}" for c in TRAIN_FEATURES)}
FROM feats GROUP BY label""",
)
def _features_by_label(spark, path):
    feats = text_features(prompts(spark, path), "train")
    means = [F.round(F.avg(F.round(F.col(c).cast("double"), 6)), 5).alias(c) for c in TRAIN_FEATURES]
    return feats.groupBy("label").agg(F.count("*").alias("rows"), *means)


@query(
    "text_features_train",
    f"""WITH {PLANTED}, texts AS (SELECT row_id, {TRAIN_TEXT.format('prompt')} AS t FROM planted)
SELECT row_id, {select_features_sql(False)} FROM texts""",
)
def _train(spark, path):
    return rounded(text_features(planted(spark, path).select("row_id", "prompt"), "train").drop("prompt"))


@query(
    "text_features_serve",
    f"""WITH {PLANTED}, texts AS (SELECT row_id, {SERVE_TEXT.format('prompt')} AS t FROM planted)
SELECT row_id, {select_features_sql(True)} FROM texts""",
)
def _serve(spark, path):
    return rounded(text_features(planted(spark, path).select("row_id", "prompt"), "serve").drop("prompt"))


SHARED = [c for c in SERVE_FEATURES if c in TRAIN_FEATURES]


@query(
    "feature_skew",
    f"""WITH {PLANTED}, a AS (SELECT row_id, {TRAIN_TEXT.format('prompt')} AS t FROM planted),
b AS (SELECT row_id, {SERVE_TEXT.format('prompt')} AS t FROM planted),
fa AS (SELECT row_id, {", ".join(f"CAST({feature_sql(False)[c]} AS DOUBLE) AS {c}" for c in SHARED)} FROM a),
fb AS (SELECT row_id, {", ".join(f"CAST({feature_sql(True)[c]} AS DOUBLE) AS {c}" for c in SHARED)} FROM b),
"""
    + "g AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(fa.{c} - fb.{c}) AS gap FROM fa JOIN fb ON fa.row_id = fb.row_id" for c in SHARED
    )
    + ") SELECT feature, count(*) AS rows, count(*) FILTER (gap > 1e-9) AS rows_differ, "
    "round(max(gap), 6) AS max_gap FROM g GROUP BY feature",
)
def _skew(spark, path):
    return rounded(feature_skew(planted(spark, path), "row_id"))


@query(
    "phrase_scores",
    f"""WITH {PLANTED}, texts AS (SELECT source_dataset, prompt AS t FROM planted),
s AS (SELECT source_dataset, {", ".join(f"{score_sql(g)} AS {g}" for g in PHRASE_RULES)} FROM texts)
SELECT source_dataset, {", ".join(f"CAST(sum({g}) AS BIGINT) AS {g}" for g in PHRASE_RULES)}
FROM s GROUP BY source_dataset""",
)
def _phrases(spark, path):
    low = planted(spark, path).withColumn("low", F.lower("prompt"))
    return low.groupBy("source_dataset").agg(
        *[F.sum(phrase_score(F.col("low"), p).cast("bigint")).alias(g) for g, p in PHRASE_RULES.items()]
    )


@query("normalize_train", f"SELECT doc_id, {TRAIN_TEXT.format('text')} AS text FROM documents")
def _norm_train(spark, path):
    return table(spark, path, "documents").select("doc_id", X.normalize_train(F.col("text")).alias("text"))


@query("normalize_serve", f"SELECT conv_id, turn, {SERVE_TEXT.format('text')} AS text FROM conversations")
def _norm_serve(spark, path):
    turns = table(spark, path, "conversations")
    return turns.select("conv_id", "turn", X.normalize_serve(F.col("text")).alias("text"))


# ---- embeddings --------------------------------------------------------


@query(
    "embedding_norms",
    f"""WITH {VECTORS} SELECT vec_id, CAST(len(embedding) AS BIGINT) AS embedding_dimension,
  round(sqrt(list_dot_product(embedding, embedding)), 6) AS embedding_norm FROM vectors""",
)
def _norms(spark, path):
    return rounded(matrix.embedding_stats(vectors(spark, path)).drop("embedding", "label"))


@query("embed_pca")
def _pca(spark, path):
    rows = vectors(spark, path)
    model = matrix.fit_pca(rows, k=32)
    wide = matrix.spread_columns(model.project(rows).drop("embedding"), "pca", "embed_pca", 32)
    return rounded(wide)


@query("explained_variance")
def _explained(spark, path):
    model = matrix.fit_pca(vectors(spark, path), k=32)
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explained)]
    shares = spark.createDataFrame(rows, "component int, explained double")
    return shares.withColumn("explained_sum", F.lit(model.explained_variance_sum()))


@query("assemble_features")
def _assemble(spark, path):
    vecs = vectors(spark, path)
    rows = planted_labelled(spark, path).join(
        vecs.select(F.col("vec_id").alias("row_id"), "embedding"), "row_id", "left"
    )
    return engineered_table(rows, matrix.fit_pca(vecs, k=32)).drop("prompt")


# ---- matrix ------------------------------------------------------------

NUMERIC = ["char_length", "word_count", "avg_word_length", "uppercase_ratio", "whitespace_ratio",
           "punctuation_ratio", "special_char_ratio", "newline_count"]


def features(spark, path, keep=("row_id", "label")):
    feats = text_features(planted_labelled(spark, path), "train")
    cols = [F.round(F.col(c).cast("double"), 6).alias(c) for c in TRAIN_FEATURES]
    # fitting and applying both read the narrow table; texts are scanned once
    return materialise(feats.select(*keep, *cols))


@query(
    "select_features",
    f"WITH {TRAIN_SQL} SELECT row_id, CAST(word_count AS DOUBLE) AS word_count, "
    "CAST(0.0 AS DOUBLE) AS embed_pca_1, punctuation_ratio FROM feats",
)
def _select(spark, path):
    return matrix.select_features(
        features(spark, path), ["word_count", "embed_pca_1", "punctuation_ratio"], keep=["row_id"]
    )


@query(
    "fill_missing",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), 0.5) AS quality, coalesce(CAST(l.toxic AS DOUBLE), 0.0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _fill(spark, path):
    labels = table(spark, path, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")
    )
    joined = table(spark, path, "documents").select("doc_id").join(labels, "doc_id", "left")
    return matrix.fill_missing(joined, {"quality": 0.5, "toxic": 0.0, "absent": 1.0})


@query(
    "feature_correlations",
    f"WITH {TRAIN_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 5) AS corr FROM feats"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    ),
)
def _corr(spark, path):
    return rounded(matrix.correlation_table(features(spark, path), NUMERIC), 5)


@query("drop_correlated")
def _drop_corr(spark, path):
    feats = features(spark, path)
    return matrix.drop_correlated(feats.select("row_id", *TRAIN_FEATURES), matrix.correlated_columns(feats, TRAIN_FEATURES))


@query(
    "variance_table",
    f"WITH {TRAIN_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 5) AS variance FROM feats" for c in TRAIN_FEATURES),
)
def _variance(spark, path):
    return rounded(matrix.variance_table(features(spark, path), TRAIN_FEATURES), 5)


@query(
    "variance_select",
    f"WITH {TRAIN_SQL}, v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM feats" for c in TRAIN_FEATURES)
    + ") SELECT feature, round(variance, 5) AS variance FROM v WHERE variance > 0",
)
def _variance_select(spark, path):
    rows = features(spark, path)
    kept = matrix.variance_select(rows, TRAIN_FEATURES)
    return rounded(matrix.variance_table(rows, kept), 5)


def scaled_sql(centre: str, scale: str) -> str:
    cols = ", ".join(
        f"round((f.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1.0 ELSE s.s_{c} END, 5) AS {c}" for c in TRAIN_FEATURES
    )
    stats = ", ".join(f"{centre.format(c)} AS m_{c}, {scale.format(c)} AS s_{c}" for c in TRAIN_FEATURES)
    return f"WITH {TRAIN_SQL}, s AS (SELECT {stats} FROM feats) SELECT row_id, {cols} FROM feats f CROSS JOIN s"


@query("scale_standard", scaled_sql("avg({0})", "stddev_pop({0})"))
def _standard(spark, path):
    feats = features(spark, path).select("row_id", *TRAIN_FEATURES)
    return rounded(matrix.fit_standard(feats, TRAIN_FEATURES).apply(feats), 5)


@query(
    "scale_robust",
    scaled_sql(
        "quantile_cont(CAST({0} AS DOUBLE), 0.5)",
        "(quantile_cont(CAST({0} AS DOUBLE), 0.75) - quantile_cont(CAST({0} AS DOUBLE), 0.25))",
    ),
)
def _robust(spark, path):
    feats = features(spark, path).select("row_id", *TRAIN_FEATURES)
    return rounded(matrix.fit_robust(feats, TRAIN_FEATURES).apply(feats), 5)


@query("scale_quantile_normal")
def _quantile(spark, path):
    feats = features(spark, path).select("row_id", "label", *TRAIN_FEATURES)
    scaler = matrix.fit_quantile_normal(feats.where("label = 0"), TRAIN_FEATURES)
    return rounded(scaler.apply(feats))


@query("rf_importance")
def _importance(spark, path):
    return matrix.rf_importance(features(spark, path), TRAIN_FEATURES)


@query("select_by_importance")
def _select_importance(spark, path):
    table_ = matrix.rf_importance(features(spark, path), TRAIN_FEATURES)
    return matrix.select_by_importance(table_)


@query(
    "select_by_share",
    """WITH t AS (SELECT source AS feature, round(count(*) FILTER (lang = 'de') / CAST(count(*) AS DOUBLE), 6) AS importance
  FROM documents GROUP BY source), r AS (SELECT *, max(importance) OVER () AS best,
  row_number() OVER (ORDER BY importance DESC, feature) AS rn FROM t)
SELECT feature, importance FROM r WHERE importance >= 0.16 OR (best < 0.16 AND rn <= 5)""",
)
def _select_share(spark, path):
    docs = table(spark, path, "documents").groupBy(F.col("source").alias("feature")).agg(
        F.round(F.count_if(F.col("lang") == "de") / F.count("*").cast("double"), 6).alias("importance")
    )
    return matrix.select_by_importance(docs, 0.16, 5)


@query(
    "encoded_source_features",
    f"""WITH {PLANTED_LABELLED} SELECT row_id, label,
  CAST(dense_rank() OVER (ORDER BY source_dataset) - 1 AS BIGINT) AS source_dataset_encoded FROM planted_labelled""",
)
def _encoded(spark, path):
    rows = planted_labelled(spark, path).select("row_id", "label", "source_dataset")
    coded = encode_sources(rows).drop("source_dataset")
    return coded.select("row_id", "label", F.col("source_dataset_encoded").cast("bigint"))
