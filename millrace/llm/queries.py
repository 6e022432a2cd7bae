"""The queries of this subpackage over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bytecnn, deobfuscate, hilbert, jaccard, packing, rulelists, secrets, suffixes, templates, tiling


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.remove_templates(_read(spark, sf_dir, "pages"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(_read(spark, sf_dir, "documents"))


def hilbert_cut_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 with small shards, so that runs and large cells are cut in small tables too."""
    return hilbert.hilbert_shards(_read(spark, sf_dir, "documents"), target_chars=20_000)


def op3_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deobfuscate.find_pii(_read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_read(spark, sf_dir, "documents"))


def op5_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op7_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return bytecnn.keep_good(docs, bytecnn.fit_quality(docs, _read(spark, sf_dir, "labels")))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return rulelists.judge(docs, rulelists.fit_rules(docs, _read(spark, sf_dir, "labels")))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_by_retrieval(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_templates": op1_site_templates,
    "op2_hilbert_shards": op2_hilbert_shards,
    "hilbert_cut_runs": hilbert_cut_runs,
    "op3_disguised_pii": op3_disguised_pii,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_benchmark_tiling": op5_benchmark_tiling,
    "op6_secret_guess_cost": op6_secret_guess_cost,
    "op7_byte_network": op7_byte_network,
    "op8_decision_list": op8_decision_list,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_retrieval_packing": op10_retrieval_packing,
}

ORACLES: dict[str, str] = {"op2_hilbert_shards": hilbert.oracle(), "hilbert_cut_runs": hilbert.oracle(target_chars=20_000), "op4_jaccard_join": jaccard.oracle(), "op9_suffix_repeats": suffixes.oracle()}
