"""The training corpus, stage by stage. Each stage's result is written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bytecnn, jaccard, packing, secrets, tiling
from millrace.llm.store import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the byte network, trained on the labels, takes for bad, and null and empty texts.

    A null doc_id and rows that repeat one are decided by their text. An empty table stays empty; all columns stay.
    """
    return bytecnn.keep_good(docs, bytecnn.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group that the n-gram Jaccard join connects.

    Rows with a null doc_id and texts without words stay; rows that repeat a doc_id share its fate. All columns stay.
    """
    return jaccard.keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose tiles cover a benchmark item.

    Rows with a null doc_id, null and empty texts stay; rows that repeat a doc_id share its fate. All columns stay.
    """
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the values of credentials that are costly to guess; all rows and columns stay, null and empty texts as they are."""
    return secrets.mask_secrets(docs)


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows with their lexical neighbours; null doc_ids and texts without words are in none."""
    return packing.pack_by_retrieval(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("packing", packing_windows),
]

#: A trained network and the greedy algorithms are no SQL; tests hold run() against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
