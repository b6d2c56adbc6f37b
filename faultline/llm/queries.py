"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_tree, decision_list, decontaminate, jaccard_join, license_digest, oracles, packing, suffix_dedup, token_store, toxicity, wrapper_extract
from .common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(_table(spark, sf_dir, "documents"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.train(docs, _table(spark, sf_dir, "labels"))
    return decision_list.apply(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orc-tokens")
    token_store.write(_table(spark, sf_dir, "documents"), path)
    return token_store.summary(spark, path)


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_context_tree_weighting, op2_decision_list, op3_sum_of_squares_packing, op4_jaccard_join, op5_wrapper_induction, op6_suffix_dedup, op7_decontamination, op8_orc_tokens, op9_license_digests, op10_toxicity)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard_join": oracles.jaccard_join(4, 85),
        "op7_decontamination": oracles.decontamination(10),
        "op9_license_digests": license_digest.sql(),
    }
