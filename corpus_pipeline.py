"""Training-data pipeline over ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text.  Rows with a null id pass every
stage that decides by id.  Empty tables pass as empty tables.  The session's Arrow batches,
if it leaves them at 64 MB, are bounded to 4 MB from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cotrain, decontaminate, line_dedup, minhash, sentencepiece_codec
from tidemark.llm.common import broadcast_if_small, small_batches, stored
from tidemark.llm.queries import PIECE_MODEL, vocabulary

ORACLE_SQL = None  # a fitted classifier has no SQL; the tests hold the stages against plain Python


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (doc_id, stored)."""
    return docs.join(broadcast_if_small(ids), "doc_id", "anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    small_batches(spark)
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = cotrain.score(docs.withColumns({f"_{c}": F.col(c) for c in docs.columns}), model, [f"_{c}" for c in docs.columns], text_col="_text")
    return scored.where("accepted").select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; no document goes."""
    out = line_dedup.drop_boilerplate_lines(docs.withColumnsRenamed({"n_lines": "_n_lines", "n_dropped": "_n_dropped"}))
    out = out.drop("n_lines", "n_dropped").withColumnsRenamed({"_n_lines": "n_lines", "_n_dropped": "n_dropped"})
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id.  Of
    rows that repeat an id and a text one stays; an id goes only if no row of it stays."""
    found = stored(minhash.near_duplicates(docs), "pipeline-components")
    per_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    per_id = stored(per_id.where("NOT kept OR n > 1"), "pipeline-copies")
    out = without(docs, per_id.where("NOT kept").select("doc_id"))
    again = per_id.where("kept AND n > 1").select("doc_id")
    if again.isEmpty():
        return out
    repeats = out.join(broadcast_if_small(again), "doc_id", "semi").dropDuplicates(["doc_id", "text"])
    return without(out, again).unionByName(repeats.select(*docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a window of a benchmark item, whatever their id."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the text that they decode to."""
    small_batches(spark)
    coded = sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), vocabulary(PIECE_MODEL))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{STAGES.index((name, stage))}")
    return STAGES[-1][1](spark, docs, sf_dir)
