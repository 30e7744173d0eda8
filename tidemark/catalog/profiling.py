"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tables import MERGED, PROMPTS, merged, prompts, quoted, rounded, table
from tidemark.functions.features import add_word_count
from tidemark.functions.stopwords import ENGLISH
from tidemark.operators import profile

SCORE_BINS = 20


@query("label_distribution", f'WITH {MERGED} SELECT label, count(*) AS "count" FROM merged GROUP BY label')
def _labels(spark, path):
    return profile.label_distribution(merged(spark, path))


@query("source_distribution", f'WITH {PROMPTS} SELECT source_dataset, count(*) AS "count" FROM prompts GROUP BY 1')
def _sources(spark, path):
    return profile.source_distribution(prompts(spark, path))


@query(
    "source_by_label",
    f"""WITH {MERGED} SELECT source_dataset, count(*) AS total,
  count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM merged GROUP BY 1""",
)
def _source_label(spark, path):
    return profile.source_by_label(merged(spark, path))


LENGTHS = PROMPTS + r""", lengths AS (
  SELECT *, length(prompt) AS char_length, len(regexp_extract_all(prompt, '\S+')) AS word_count FROM prompts)"""


def describe_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"WITH {LENGTHS} " + " UNION ALL ".join(
        f"""SELECT {lead}'{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lengths {group}"""
        for c in ("char_length", "word_count")
    )


def lengths(spark, path):
    return add_word_count(prompts(spark, path)).drop("prompt")


@query("describe_lengths", describe_sql())
def _describe(spark, path):
    return rounded(profile.describe(lengths(spark, path), ["char_length", "word_count"]))


@query("describe_by_label", describe_sql("label"))
def _describe_by(spark, path):
    out = profile.describe(lengths(spark, path), ["char_length", "word_count"], ["label"])
    return out.select("label", "column", "count", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query(
    "describe_token_count",
    r"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '\S+')) + 2 AS token_count FROM documents)
SELECT lang, 'token_count' AS "column", count(*) AS "count", round(avg(token_count), 6) AS mean,
  round(stddev_samp(token_count), 6) AS std, CAST(min(token_count) AS DOUBLE) AS min,
  round(quantile_cont(CAST(token_count AS DOUBLE), 0.25), 6) AS q25,
  round(quantile_cont(CAST(token_count AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST(token_count AS DOUBLE), 0.75), 6) AS q75, CAST(max(token_count) AS DOUBLE) AS max
FROM t GROUP BY lang""",
)
def _describe_tokens(spark, path):
    docs = table(spark, path, "documents").select("lang", "text")
    counted = add_word_count(docs, "text").select("lang", (F.col("word_count") + 2).alias("token_count"))
    return rounded(profile.describe(counted, ["token_count"], ["lang"]))


def histogram_sql(source: str, x: str, bins: int, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM v) g CROSS JOIN " if by else ""
    match = f"c.bin = s.bin AND c.{by} = g.{by}" if by else "c.bin = s.bin"
    first = f"g.{by}, " if by else ""
    return f"""v AS (SELECT {lead}CAST({x} AS DOUBLE) AS x FROM {source} WHERE {x} IS NOT NULL),
b AS (SELECT min(x) AS lo, (max(x) - min(x)) / CAST({bins} AS DOUBLE) AS w FROM v),
c AS (SELECT {lead}CAST(least(floor((x - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM v, b GROUP BY ALL),
h AS (SELECT {first}s.bin, b.lo + s.bin * b.w AS low, b.lo + (s.bin + 1) * b.w AS high, coalesce(c.n, 0) AS n
  FROM {groups}(SELECT range AS bin FROM range({bins})) s CROSS JOIN b LEFT JOIN c ON {match})"""


@query(
    "histogram_chars",
    "WITH " + histogram_sql("documents", "length(text)", 50)
    + ' SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n AS "count" FROM h',
)
def _histogram(spark, path):
    docs = table(spark, path, "documents").select(F.length("text").alias("char_length"))
    return rounded(profile.histogram(docs, "char_length"))


@query(
    "histogram_latency",
    "WITH " + histogram_sql("events", "value", 50)
    + ' SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n AS "count" FROM h',
)
def _latency_histogram(spark, path):
    return rounded(profile.histogram(table(spark, path, "events"), "value"))


@query(
    "score_density",
    "WITH " + histogram_sql("events", "value", SCORE_BINS, "event_type")
    + ' SELECT event_type, bin, round(low, 6) AS low, round(high, 6) AS high, n AS "count", '
    + "round(n / (sum(n) OVER (PARTITION BY event_type) * (high - low)), 6) AS density FROM h",
)
def _density(spark, path):
    return rounded(profile.score_density(table(spark, path, "events"), "value", "event_type", SCORE_BINS))


@query(
    "boxplot_words",
    f"""WITH {LENGTHS}, q AS (SELECT label, quantile_cont(CAST(word_count AS DOUBLE), 0.25) AS q25,
    quantile_cont(CAST(word_count AS DOUBLE), 0.5) AS median, quantile_cont(CAST(word_count AS DOUBLE), 0.75) AS q75
  FROM lengths GROUP BY label)
SELECT l.label, q25, median, q75, q75 - q25 AS iqr,
  CAST(min(word_count) FILTER (word_count BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS DOUBLE) AS whisker_low,
  CAST(max(word_count) FILTER (word_count BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS DOUBLE) AS whisker_high,
  count(*) FILTER (NOT word_count BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers
FROM lengths l JOIN q ON l.label = q.label GROUP BY l.label, q25, median, q75""",
)
def _boxplot(spark, path):
    return profile.boxplot_stats(lengths(spark, path), "word_count")


@query(
    "top_terms",
    rf"""WITH {PROMPTS}, w AS (SELECT unnest(regexp_extract_all(lower(prompt), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word
  FROM prompts WHERE label = 1)
SELECT word, count(*) AS "count" FROM w WHERE word NOT IN ({", ".join(quoted(w) for w in ENGLISH)})
GROUP BY word ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _top_terms(spark, path):
    return profile.top_terms(prompts(spark, path), stop_words=ENGLISH)


@query(
    "sample_by_label",
    f"""WITH {PROMPTS} SELECT row_id, label, prompt FROM (SELECT *, row_number() OVER (
  PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM prompts) WHERE rn <= 10""",
)
def _sample(spark, path):
    return profile.sample_by_label(prompts(spark, path)).select("row_id", "label", "prompt")


@query(
    "preview_sample",
    "SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || doc_id)) AS rn FROM documents) "
    "WHERE rn <= 20",
)
def _preview(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "source")
    return profile.preview_sample(docs, "doc_id", 20, 7)


@query(
    "sample_prompts",
    """SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 4000) || '...' ELSE text END AS sample
FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rn FROM documents) WHERE rn <= 15""",
)
def _sample_prompts(spark, path):
    return profile.sample_prompts(table(spark, path, "documents"), "doc_id")


