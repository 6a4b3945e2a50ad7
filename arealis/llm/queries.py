"""The queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import byte_bpe, decontam, filter_audit, license_scan, matroska, merkle, nbsvm, ngram_jaccard, oracles, orc_tokens, suffix_dedup, token_counts, toxicity, window_index
from arealis.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "n_near", F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"), "contaminated")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.media_column(table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index.digests(window_index.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.stored_offsets(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return nbsvm.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.documents_manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", "verified")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumns({"evidence_ids": F.col("evidence.id"), "nearest_cosine": F.coalesce(F.expr("get(evidence, 0).cosine"), F.lit(0.0))}).drop("evidence")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
