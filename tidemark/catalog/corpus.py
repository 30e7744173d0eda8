"""Sources, harmonising, cleaning and dataset build."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tables import (
    CLEANED, MERGED, PLANTED, PROMPTS, READY, SOURCES, merged, planted, prompts, raw_sources, rounded,
    strip_sql, table,
)
from tidemark.functions.text import normalize_clean
from tidemark.operators import build, clean, harmonise
from tidemark.operators.harmonise import label_name
from tidemark.operators.sampling import sample_exact
from tidemark.session import scratch_path
from tidemark.sources import readers, writers

TABLES = ("benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages")
CAP = 200
DOC_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURN_COLUMNS = "conv_id bigint, turn bigint, role string, text string"

# ---- sources -----------------------------------------------------------


@query("read_parquet", "SELECT source, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def _read_parquet(spark, path):
    docs = readers.read_table(spark, f"{path}/documents.parquet")
    return docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _csv(spark, path):
    target = scratch_path(spark, "documents") + ".csv"
    writers.write_csv(table(spark, path, "documents"), target)
    return readers.read_table(spark, target, DOC_COLUMNS)


@query("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def _jsonl(spark, path):
    target = scratch_path(spark, "conversations") + ".jsonl"
    writers.write_metrics_json(table(spark, path, "conversations"), target)
    return readers.read_table(spark, target, TURN_COLUMNS).select("conv_id", "turn", "role", "text")


@query(
    "read_many",
    """
WITH parts AS (SELECT 'documents' AS split, text FROM documents
               UNION ALL SELECT 'turns', text FROM conversations)
SELECT split, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM parts GROUP BY split""",
)
def _read_many(spark, path):
    parts = {"documents": f"{path}/documents.parquet", "turns": f"{path}/conversations.parquet"}
    return readers.read_many(spark, parts).groupBy("split").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "load_prompts",
    f"WITH {PROMPTS} SELECT row_id, prompt AS text, CAST(label AS INTEGER) AS label FROM prompts",
)
def _load_prompts(spark, path):
    return readers.as_prompts(prompts(spark, path).withColumnRenamed("prompt", "Prompt"), keep=["row_id"])


@query(
    "dataset_catalog",
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t})) AS columns"
        for t in TABLES
    ),
)
def _catalog(spark, path):
    return readers.dataset_catalog({t: table(spark, path, t) for t in TABLES})


# ---- harmonise ---------------------------------------------------------


@query("merge_sources", f"WITH {MERGED} SELECT prompt, label, source_dataset FROM merged")
def _merge(spark, path):
    return merged(spark, path)


@query(
    "source_summary",
    f"""WITH {MERGED} SELECT source_dataset AS dataset, count(*) AS rows_kept,
  CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS malicious_count,
  CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS benign_count,
  CASE source_dataset {' '.join(f"WHEN '{c.name}' THEN '{c.prompt_col}'" for c in SOURCES)} END AS prompt_column_used,
  CASE source_dataset {' '.join(f"WHEN '{c.name}' THEN '{c.label_col}'" for c in SOURCES)} END AS label_column_used
FROM merged GROUP BY source_dataset""",
)
def _source_summary(spark, path):
    return harmonise.source_summary(merged(spark, path), SOURCES)


@query(
    "merged_label_names",
    f"""WITH {MERGED} SELECT CASE label WHEN 0 THEN 'Benign' WHEN 1 THEN 'Malicious' END AS label_name,
  count(*) AS rows FROM merged GROUP BY label""",
)
def _label_names(spark, path):
    named = merged(spark, path).withColumn("label_name", label_name(F.col("label")))
    return named.groupBy("label_name").agg(F.count("*").alias("rows"))


@query(
    "parse_benign",
    f"""WITH raw AS (
  SELECT event_id, event_type AS value FROM events
  UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN ' Benign ' ELSE 'harmful' END FROM labels
  UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'TRUE' ELSE ' no' END FROM labels
  UNION ALL SELECT d.doc_id, CAST(l.toxic AS VARCHAR) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
words AS (SELECT value, lower({strip_sql('value')}) AS w FROM raw)
SELECT value, count(*) AS rows,
  CASE WHEN w IS NULL OR w IN ('1','true','t','yes','y') THEN false
       WHEN w IN ('0','false','f','no','n') THEN true
       ELSE w IN ('0','benign','normal','ham','false') END AS is_benign
FROM words GROUP BY value, w""",
)
def _parse_benign(spark, path):
    labels, docs = table(spark, path, "labels"), table(spark, path, "documents").select("doc_id")
    raw = (
        table(spark, path, "events").select(F.col("event_type").alias("value"))
        .union(labels.select(F.when(F.col("quality") == 1, " Benign ").otherwise("harmful")))
        .union(labels.select(F.when(F.col("toxic") == 1, "TRUE").otherwise(" no")))
        .union(docs.join(labels, "doc_id", "left").select(F.col("toxic").cast("string")))
    )
    counts = raw.groupBy("value").agg(F.count("*").alias("rows"))
    return counts.withColumn("is_benign", harmonise.parse_benign(F.col("value")))


@query(
    "validate_length",
    """SELECT coalesce(length(text) BETWEEN 1 AND 20000, false) AS is_valid, count(*) AS rows,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""",
)
def _validate(spark, path):
    checked = harmonise.validate_length(table(spark, path, "documents"), "text")
    return checked.groupBy("is_valid").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))


# ---- cleaning ----------------------------------------------------------


@query(
    "schema_report",
    f"""WITH {MERGED} SELECT 'prompt' AS "column", 'string' AS dtype, count(prompt) AS non_null FROM merged
UNION ALL SELECT 'label', 'int', count(label) FROM merged
UNION ALL SELECT 'source_dataset', 'string', count(source_dataset) FROM merged""",
)
def _schema_report(spark, path):
    return clean.schema_report(merged(spark, path))


LABELLED_OR_NOT = """joined AS (
  SELECT d.doc_id, d.text, l.toxic, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled_or_not(spark, path):
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "toxic", "quality")


@query(
    "missing_summary",
    f"WITH {LABELLED_OR_NOT} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent FROM joined"""
        for c in ("doc_id", "text", "toxic", "quality")
    ),
)
def _missing(spark, path):
    return clean.missing_summary(labelled_or_not(spark, path))


@query("value_counts", f'WITH {LABELLED_OR_NOT} SELECT toxic, count(*) AS "count" FROM joined GROUP BY toxic')
def _value_counts(spark, path):
    return clean.value_counts(labelled_or_not(spark, path), "toxic")


@query(
    "duplicate_counts",
    f"""WITH {MERGED}
SELECT 'duplicate_rows' AS scope, (SELECT count(*) FROM merged)
  - (SELECT count(*) FROM (SELECT DISTINCT prompt, label, source_dataset FROM merged)) AS duplicates
UNION ALL SELECT 'duplicate_prompts', (SELECT count(*) FROM merged)
  - (SELECT count(*) FROM (SELECT DISTINCT prompt FROM merged))""",
)
def _duplicates(spark, path):
    return clean.duplicate_counts(merged(spark, path))


@query("drop_empty_prompts", f"WITH {MERGED} SELECT * FROM merged WHERE prompt IS NOT NULL AND prompt <> ''")
def _drop_empty(spark, path):
    return clean.drop_empty_prompts(merged(spark, path))


@query("normalize_clean", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _normalize(spark, path):
    return table(spark, path, "documents").select("doc_id", normalize_clean(F.col("text")).alias("text"))


@query("drop_exact_duplicates", f"WITH {READY} SELECT DISTINCT prompt, label, source_dataset FROM ready")
def _drop_duplicates(spark, path):
    ready = clean.normalize_prompts(clean.drop_empty_prompts(merged(spark, path)))
    return clean.drop_exact_duplicates(ready)


@query(
    "label_conflicts",
    f"""WITH {READY} SELECT prompt, count(DISTINCT label) AS n_unique_labels
FROM ready GROUP BY prompt HAVING count(DISTINCT label) > 1""",
)
def _conflicts(spark, path):
    return clean.label_conflicts(clean.normalize_prompts(clean.drop_empty_prompts(merged(spark, path))))


@query(
    "conflict_examples",
    f"""WITH {READY}, bad AS (SELECT prompt FROM ready GROUP BY prompt HAVING count(DISTINCT label) > 1
  ORDER BY prompt LIMIT 5)
SELECT prompt, label, source_dataset FROM ready WHERE prompt IN (SELECT prompt FROM bad)""",
)
def _conflict_examples(spark, path):
    ready = clean.normalize_prompts(clean.drop_empty_prompts(merged(spark, path)))
    return clean.conflict_examples(ready, 5)


@query("drop_conflicts", f"""WITH {READY} SELECT prompt, label, source_dataset FROM ready
WHERE prompt NOT IN (SELECT prompt FROM ready GROUP BY prompt HAVING count(DISTINCT label) > 1)""")
def _drop_conflicts(spark, path):
    return clean.drop_conflicts(clean.normalize_prompts(clean.drop_empty_prompts(merged(spark, path))))


@query("clean_corpus", f"WITH {CLEANED} SELECT prompt, label, source_dataset FROM cleaned")
def _clean(spark, path):
    return clean.clean(merged(spark, path))


@query(
    "cleaning_summary",
    f"""WITH {CLEANED}, n AS (SELECT count(*) AS c, count(DISTINCT prompt) AS p,
    sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS zeros, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ones,
    sum(CASE WHEN prompt IS NULL THEN 1 ELSE 0 END) AS np, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS nl
  FROM cleaned)
SELECT 'original_rows' AS metric, (SELECT count(*) FROM merged) AS value
UNION ALL SELECT 'cleaned_rows', c FROM n
UNION ALL SELECT 'columns', 3
UNION ALL SELECT 'missing_prompts_remaining', CAST(np AS BIGINT) FROM n
UNION ALL SELECT 'missing_labels_remaining', CAST(nl AS BIGINT) FROM n
UNION ALL SELECT 'exact_duplicate_rows_remaining',
  (SELECT c FROM n) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned))
UNION ALL SELECT 'duplicate_prompts_remaining', c - p FROM n
UNION ALL SELECT 'conflicting_prompt_count', (SELECT count(*) FROM
  (SELECT prompt FROM ready GROUP BY prompt HAVING count(DISTINCT label) > 1))
UNION ALL SELECT 'label_0_count', CAST(zeros AS BIGINT) FROM n
UNION ALL SELECT 'label_1_count', CAST(ones AS BIGINT) FROM n""",
)
def _cleaning_summary(spark, path):
    return clean.cleaning_summary(merged(spark, path))


@query(
    "step_deltas",
    f"""WITH {CLEANED}, n AS (SELECT (SELECT count(*) FROM merged) AS a, (SELECT count(*) FROM ready) AS b,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM ready)) AS c, (SELECT count(*) FROM cleaned) AS d)
SELECT 'drop_empty_prompts' AS step, a AS before, b AS after, a - b AS removed FROM n
UNION ALL SELECT 'drop_exact_duplicates', b, c, b - c FROM n
UNION ALL SELECT 'drop_conflicts', c, d, c - d FROM n""",
)
def _step_deltas(spark, path):
    return clean.step_deltas(merged(spark, path))


# ---- build -------------------------------------------------------------


def documents_as_rows(spark, path):
    return table(spark, path, "documents").select(F.col("doc_id").alias("row_id"), "text")


@query(
    "dedup_normalized",
    f"""SELECT row_id, text FROM (
  SELECT doc_id AS row_id, text,
         row_number() OVER (PARTITION BY md5(lower({strip_sql('text')})) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""",
)
def _dedup(spark, path):
    return build.dedup_normalized(documents_as_rows(spark, path))


@query(
    "clean_short",
    f"SELECT doc_id AS row_id, {strip_sql('text')} AS text FROM documents WHERE length({strip_sql('text')}) >= 5",
)
def _short(spark, path):
    return build.clean_short(documents_as_rows(spark, path))


@query(
    "balance_classes",
    f"""WITH {PROMPTS} SELECT row_id, label FROM (SELECT row_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM prompts) WHERE rn <= {CAP}""",
)
def _balance(spark, path):
    return build.balance_classes(prompts(spark, path).select("row_id", "label"), cap=CAP)


def split_sql(first: float, second: float | None, names: tuple[str, ...], by: str = "PARTITION BY label") -> str:
    """Held-out sizes are ceilings: after the first part, then after the second."""
    rest = "0" if second is None else f"CAST(ceil(round(rest * CAST({second} AS DOUBLE), 9)) AS BIGINT)"
    last = names[1] if second is None else names[2]
    middle = "" if second is None else f"WHEN rn <= n - {rest} THEN '{names[1]}'"
    return f"""SELECT row_id, label, CASE WHEN rn <= n - rest THEN '{names[0]}' {middle} ELSE '{last}' END AS split
FROM (SELECT *, CAST(ceil(round(n * CAST({first} AS DOUBLE), 9)) AS BIGINT) AS rest FROM (
  SELECT row_id, label, count(*) OVER ({by}) AS n,
         row_number() OVER ({by} ORDER BY md5('42:' || row_id)) AS rn FROM prompts))"""


def split_query(fractions, by=("label",)):
    def run(spark, path):
        rows = prompts(spark, path).select("row_id", "label")
        return build.stratified_split(rows, fractions=fractions, by=by)

    return run


SPLIT = split_sql(0.3, 0.5, ("train", "val", "test"))
query("stratified_split", f"WITH {PROMPTS} {SPLIT}")(split_query(build.BUILD_FRACTIONS))
query("split_60_20_20", f"WITH {PROMPTS} {split_sql(0.4, 0.5, ('train', 'val', 'test'))}")(
    split_query(build.ANOMALY_FRACTIONS)
)
query(
    "split_test_first",
    f"WITH {PROMPTS} {split_sql(0.85, 0.7 / 0.85, ('test', 'val', 'train'))}",
)(split_query(build.TEST_FIRST_FRACTIONS))
query(
    "split_holdout",
    f"WITH {PROMPTS} {split_sql(0.1, None, ('train', 'holdout'), '')}",
)(split_query(build.HOLDOUT_FRACTIONS, ()))

SPLITS = f"{PROMPTS}, splits AS ({SPLIT})"


def splits(spark, path):
    return build.stratified_split(prompts(spark, path).select("row_id", "label"))


@query(
    "split_metadata",
    f"""WITH {SPLITS}, named AS (SELECT split, CASE label WHEN 0 THEN 'Benign' ELSE 'Malicious' END AS label_name FROM splits)
SELECT split, label_name, count(*) AS rows FROM named GROUP BY split, label_name
UNION ALL SELECT split, NULL, count(*) FROM named GROUP BY split""",
)
def _metadata(spark, path):
    named = splits(spark, path).withColumn("label_name", label_name(F.col("label")))
    return build.split_metadata(named)


@query(
    "split_round_trip",
    f"WITH {SPLITS} SELECT row_id, label, split FROM splits WHERE split = 'val'",
)
def _split_files(spark, path):
    target = scratch_path(spark, "splits")
    writers.write_splits(splits(spark, path), target)
    return readers.load_split(spark, target, "val").select("row_id", "label", "split")


@query(
    "class_weights",
    f"""WITH {PROMPTS}, c AS (SELECT label, count(*) AS n FROM prompts GROUP BY label),
t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT v.label, coalesce(c.n, 0) AS "count",
  round(CAST(t.total AS DOUBLE) / (t.k * coalesce(c.n, 1)), 6) AS weight
FROM (VALUES (0), (1)) v(label) LEFT JOIN c ON c.label = v.label CROSS JOIN t""",
)
def _weights(spark, path):
    out = build.class_weights(prompts(spark, path))
    return out.select("label", "count", F.round("weight", 6).alias("weight"))


@query(
    "label_shares",
    f"""WITH {SPLITS} SELECT split, label, count(*) AS rows,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE), 6) AS share
FROM splits GROUP BY split, label""",
)
def _shares(spark, path):
    out = build.label_shares(splits(spark, path))
    return out.select("split", "label", "rows", F.round("share", 6).alias("share"))


@query("benign_train_rows", f"WITH {SPLITS} SELECT row_id FROM splits WHERE split = 'train' AND label = 0")
def _benign(spark, path):
    return build.benign_only(splits(spark, path)).select("row_id")


@query(
    "cap_rows",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rn FROM documents)
WHERE rn <= 500""",
)
def _cap(spark, path):
    return sample_exact(table(spark, path, "documents").select("doc_id"), "doc_id", 500)


@query(
    "build_dataset",
    f"""WITH {PROMPTS}, dedup AS (SELECT row_id, {strip_sql('prompt')} AS text, label FROM (
    SELECT *, row_number() OVER (PARTITION BY md5(lower({strip_sql('prompt')})) ORDER BY row_id) AS rn FROM prompts)
  WHERE rn = 1 AND length({strip_sql('prompt')}) >= 5),
capped AS (SELECT row_id, text, label FROM (SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY md5('42:' || row_id)) AS rn FROM dedup) WHERE rn <= {CAP}),
sized AS (SELECT *, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id)) AS rn FROM capped),
rest AS (SELECT *, CAST(ceil(round(n * CAST(0.3 AS DOUBLE), 9)) AS BIGINT) AS rest FROM sized)
SELECT row_id, text, label, CASE label WHEN 0 THEN 'Benign' ELSE 'Malicious' END AS label_name,
  CASE WHEN rn <= n - rest THEN 'train'
       WHEN rn <= n - CAST(ceil(round(rest * CAST(0.5 AS DOUBLE), 9)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM rest""",
)
def _build(spark, path):
    rows = prompts(spark, path).select("row_id", F.col("prompt").alias("text"), "label")
    return build.build_dataset(rows, cap=CAP).select("row_id", "text", "label", "label_name", "split")


@query(
    "source_encoding",
    f"""WITH {PLANTED} SELECT row_id, source_dataset,
  CAST(dense_rank() OVER (ORDER BY source_dataset) - 1 AS BIGINT) AS source_dataset_encoded FROM planted""",
)
def _encoding(spark, path):
    return rounded(build.encode_sources(planted(spark, path).select("row_id", "source_dataset")))


@query(
    "assign_row_id",
    f"""WITH {MERGED} SELECT source_dataset, md5(concat_ws(chr(31), prompt, label, source_dataset)) AS row_id
FROM merged WHERE prompt IS NOT NULL""",
)
def _row_id(spark, path):
    rows = build.assign_row_id(merged(spark, path), "prompt", "label", "source_dataset")
    return rows.select("source_dataset", "row_id")
