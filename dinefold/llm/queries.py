"""Registered queries of this subpackage and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dinefold.llm import chunk_bpe, filter_audit, fourier_quality, language_id, packing, pii, rans_files, runs, shuffle_shards, suffix_dedup, tree_dedup, vp_search, vp_simhash
from dinefold.llm.common import table

BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_files.token_file_report(table(spark, sf_dir, "documents"), BPE, end_id=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op3_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.coding_report(table(spark, sf_dir, "documents"), BPE)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op5_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_tree_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_dedup.tree_dedup(table(spark, sf_dir, "documents"), keep="max").drop("_row")


def op7_vp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.search_report(table(spark, sf_dir, "embeddings"))


def op8_vp_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), packing.byte_tokens())


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_shards.shard_report(table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(masks, "ABCDE")


def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier_quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(spark, sf_dir, "documents"))


def llm_queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}


def llm_oracles() -> dict[str, str]:
    return {"op6_tree_exact_dedup": tree_dedup.ORACLE, "op11_filter_interactions": filter_audit.ORACLE}
