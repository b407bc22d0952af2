"""The registered queries of the numbered operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import language_model, languages
from flowsieve.llm.centroids import cluster_digest, cluster_vectors, clusters_sql
from flowsieve.llm.collision_search import nearest
from flowsieve.llm.kd_shards import shard_documents
from flowsieve.llm.leaks import find_leaks, leaks_sql
from flowsieve.llm.licences import licence_digest, licences_sql, scan_licences
from flowsieve.llm.near_copies import near_copy_clusters
from flowsieve.llm.packing import pack
from flowsieve.llm.periodic import find_runs, run_digest, with_repeated_tails
from flowsieve.llm.pii import find_pii, pii_digest
from flowsieve.llm.secrets import scan_history, span_digest
from flowsieve.llm.simhash import fingerprint_groups
from flowsieve.llm.token_counts import count_tokens
from flowsieve.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    scored = language_model.score_texts(documents, ~language_model.held_out(F.col("doc_id")))
    held_out = language_model.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), TOKENIZER)


def op3_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0)


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_groups(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(scan_licences(_documents(spark, sf_dir)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_history(_documents(spark, sf_dir), scratch_path(spark, "ledger")))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = languages.train(documents.filter(~languages.held_out(F.col("doc_id"))))
    found = languages.identify(documents, model)
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(_documents(spark, sf_dir)))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = near_copy_clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pack(documents, cluster=documents["cluster"], length=documents["n"])


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_runs(with_repeated_tails(_documents(spark, sf_dir))))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return cluster_digest(*cluster_vectors(vectors))


def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_log_bilinear_scores,
        op2_token_counts,
        op3_collision_neighbours,
        op4_simhash_groups,
        op5_license_scan,
        op6_secret_scan,
        op7_language_mixture,
        op8_pii_spans,
        op9_best_fit_packing,
        op10_benchmark_leaks,
        op11_periodic_runs,
        op12_centroid_clusters,
        op13_kd_shards,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"op5_license_scan": licences_sql(), "op10_benchmark_leaks": leaks_sql(), "op12_centroid_clusters": clusters_sql()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
