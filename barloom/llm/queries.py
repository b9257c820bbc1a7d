"""Registered queries of this package: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import findings, near, packing, pages, personal, quality, resample, search, segments, suffixes, tokens, trie, vectors
from barloom.llm.common import cut_lineage, table


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segmentation_figures(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf, "pages"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = tokens.prefix_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.within_budget(counted, 512)


def op4_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    return personal.personal_data(table(spark, sf, "documents"))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics are written once (a few numbers per document) and serve calibration and verdict."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = quality.with_statistics(table(spark, sf, "documents"))
    counted = cut_lineage(counted.select(*names, "stratum", "n_capitals", "n_lines"))
    return quality.judge(counted, quality.cutoffs(counted, table(spark, sf, "labels"))).select(*names, "kept")


def op10_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The tables hold no labelled findings: the forest learns from findings whose form proves what they are."""
    return findings.secret_scan(table(spark, sf, "documents"))


def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resample.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(*trie.shared_starts(trie.turn_digests(table(spark, sf, "conversations"))))


def op13_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_html_extraction, op3_token_counts, op4_suffix_array_dedup, op5_minhash_near_dedup, op6_embedding_near_dedup,
    op7_best_fit_packing, op8_pii, op9_quality_rules, op10_secret_scans,
    op11_importance_resampling, op12_prefix_trie, op13_exact_top_k)}
