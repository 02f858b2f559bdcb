"""Cleaning of a document table in five stages; the last one packs what is left.

Every stage works on all documents that its predecessor kept. Row numbers, which tell repeated rows
apart, are given once and written with the documents; every later step reads the written column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinefold.llm import language_id, packing, pii, tree_dedup, vp_simhash
from dinefold.session import stored


def _numbered(docs: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """docs with a written row number, and the name of its column."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), purpose), name


def _only(numbered: DataFrame, name: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in kept (_row), without the number."""
    return numbered.join(kept.select(F.col("_row").alias(name)), name, "left_semi").drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or between two languages, go."""
    kept = language_id.identify(docs, *language_id.learned(docs)).where("not rejected").drop(*language_id.NEW_COLUMNS)
    return kept.withColumnsRenamed({f"in_{c}": c for c in language_id.NEW_COLUMNS if c in docs.columns})


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    numbered, row = _numbered(docs, "exact-rows")
    kept = tree_dedup.tree_dedup(numbered, keep="max", row_col=row).where("kept")
    return _only(numbered, row, kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest id stays."""
    numbered, row = _numbered(docs, "near-rows")
    rows = numbered.select("doc_id", "text", F.col(row).alias("_row"))
    marked = stored(vp_simhash.fingerprints(rows, carry=("doc_id", "_row")), "simhash")
    group = vp_simhash.classes(marked)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("w"))
    first = marked.groupBy("fp").agg(least.alias("first"))
    kept = first.join(group, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return _only(numbered, row, kept.select("first._row"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in them is replaced."""
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, packing.byte_tokens())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: Compression and packing can't be stated in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
