"""Configuration documents: closure calendar and sheet schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinefold import params as P


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: (file, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )


def closure_calendar(docs: DataFrame) -> DataFrame:
    """Closed days per document and store; comments and entries that are no list are skipped."""
    entries = docs.select("file", F.explode(F.from_json("text", "map<string,string>")).alias("store", "days"))
    days = F.from_json("days", "array<string>")
    return (
        entries.filter((F.col("store") != "_comment") & F.startswith("days", F.lit("[")))
        .select("file", "store", F.explode(days).alias("closed_date"))
        .distinct()
    )


def allowed_missing_dates(calendar: DataFrame, stores: DataFrame) -> DataFrame:
    """Days each store may miss: those of all stores and its own."""
    for_all = calendar.filter(F.col("store") == P.ALL_STORES).drop("store")
    own = calendar.filter(F.col("store") != P.ALL_STORES).join(stores, ["file", "store"], "left_semi")
    return (
        stores.join(for_all, "file").select("file", "store", "closed_date").unionByName(
            own.select("file", "store", "closed_date")
        )
    ).distinct()


def sheet_schema(docs: DataFrame) -> DataFrame:
    """Columns per document and sheet with their required and nullable marks."""
    kind = "struct<required:array<string>,nullable:array<string>>"
    entries = docs.select("file", F.explode(F.from_json("text", "map<string,string>")).alias("sheet", "d"))
    # Notes and entries that are no object are skipped.
    sheets = entries.filter(~F.startswith("sheet", F.lit("_")) & F.startswith("d", F.lit("{"))).withColumn("d", F.from_json("d", kind))
    none = F.array().cast("array<string>")
    required, nullable = F.coalesce("d.required", none), F.coalesce("d.nullable", none)
    return sheets.select(
        "file", "sheet", required.alias("r"), nullable.alias("n"), F.explode(F.array_union(required, nullable)).alias("column")
    ).select(
        "file",
        "sheet",
        "column",
        F.array_contains("r", F.col("column")).alias("required"),
        F.array_contains("n", F.col("column")).alias("nullable"),
    )
