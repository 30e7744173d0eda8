"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chain_dedup, cotrain, decontaminate, line_dedup, minhash, multiset_hash, ns_bounds, piece_table, secrets_scan,
    sentencepiece_codec, suffix_dedup, token_output, topk,
)

PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_minhash_near_dedup")
def _near(spark, path):
    return minhash.near_duplicates(read(spark, path, "documents"))


@query("op3_line_dedup", line_dedup.SQL)
def _lines(spark, path):
    return line_dedup.drop_boilerplate_lines(read(spark, path, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op5_exact_top_k", topk.sql())
def _top(spark, path):
    vectors = read(spark, path, "embeddings").select("vec_id", topk.integer_weights(F.col("embedding")).alias("weights"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "weights")


@query("op6_sentencepiece")
def _pieces(spark, path):
    coded = sentencepiece_codec.encode_decode(read(spark, path, "documents").select("doc_id", "text"), vocabulary(PIECE_MODEL))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_output")
def _tokens(spark, path):
    docs = read(spark, path, "documents").select("doc_id", "text")
    shards = token_output.write_shards(docs, vocabulary(WORD_MODEL), end_id=1)
    index, parts = token_output.build_index(spark, shards)
    found = token_output.lookup(docs.select("doc_id").distinct(), index, parts)
    return token_output.document_checksums(token_output.read_documents(found, shards), token_output.directory(spark, shards))


@query("op7_secret_scans")
def _secrets(spark, path):
    return secrets_scan.digest(secrets_scan.find_secrets(read(spark, path, "documents")))


@query("op9_benchmark_decontamination", decontaminate.SQL)
def _leaks(spark, path):
    found = decontaminate.contamination(read(spark, path, "documents"), read(spark, path, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


@query("op4_quality_classifier")
def _quality(spark, path):
    docs = read(spark, path, "documents")
    model = cotrain.fit(docs, read(spark, path, "labels"))
    return cotrain.score(docs, model, ["doc_id"])


@query("op1_suffix_array_dedup")
def _passages(spark, path):
    return suffix_dedup.passage_summary(read(spark, path, "documents"))


@query("op10_substring_dedup")
def _fuzzy(spark, path):
    return chain_dedup.fuzzy_summary(read(spark, path, "documents"))


@query("op11_fill_in_middle", piece_table.SQL)
def _middle(spark, path):
    return piece_table.summary(read(spark, path, "documents"))


@query("op12_document_fingerprints")
def _fingerprints(spark, path):
    return multiset_hash.edit_report(read(spark, path, "documents"))


@query("op13_centroid_clustering", ns_bounds.sql())
def _clusters(spark, path):
    return ns_bounds.summary(read(spark, path, "embeddings"))


@query("pipeline")
def _pipeline(spark, path):
    import corpus_pipeline  # beside the package; it uses this module

    return corpus_pipeline.run(spark, path)
