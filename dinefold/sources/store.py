"""Keyed storage: newest-wins merge, daily overwrite, row JSON, new keys."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert_latest(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key, the one with the greatest `newest` columns.

    An aggregate rather than a window: copies of a key are reduced on the map side, so a
    key that holds a large part of all rows never reaches one task as rows. Null keys
    group together, like any value. Rows equal on key and `newest` are told apart by the
    rest of their columns, so the result does not depend on the row order.
    """
    rest = [c for c in df.columns if c not in keys and c not in newest]
    best = F.max(F.struct(*newest, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[
        F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns
    ])


def csv_by_name(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """CSV files with columns in any order: each file is read by its own first line, all columns as text.

    The first lines are found in one pass; files that share one are read together, so the driver holds one entry
    per file, as the listing of the files does. A byte order mark is no part of a name.
    """
    options = {"header": "true", "enforceSchema": "false"} | {k: str(v) for k, v in options.items()}
    lines = spark.read.text(paths).select("value", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    heads = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("head")).filter("head is not null")
    frames = []
    for head, files in heads.groupBy("head").agg(F.collect_list("file_path")).orderBy("head").collect():
        names = next(csv.reader([head.lstrip("\ufeff")], delimiter=options.get("sep", ","), quotechar=options.get("quote", '"')))
        schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in names])
        # The mark would make the first name another one, so a file that begins with it is read by position.
        by_place = {"enforceSchema": "true"} if head.startswith("\ufeff") else {}
        frames.append(spark.read.schema(schema).options(**options | by_place).csv(files).select("*", F.col("_metadata.file_name").alias("source_file")))
    if not frames:
        raise ValueError("no file has a first line")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def multi_file_load(
    spark: SparkSession, paths: list[str], keys: list[str], newest: list[str], fmt: str = "parquet", **options
) -> DataFrame:
    """Read many files into one frame, tag rows with their file, newest row per key wins.

    The frame has the columns of all files, matched by name; a column that a file lacks is null in its rows.
    CSV columns are text, so `newest` columns of CSV files compare as text.
    """
    if fmt == "csv":
        return upsert_latest(csv_by_name(spark, paths, **options), keys, newest)
    df = spark.read.format(fmt).options(**{"mergeSchema": "true"} | options).load(paths)
    return upsert_latest(df.withColumn("source_file", F.col("_metadata.file_name")), keys, newest)


def merge_archives(older: DataFrame, newer: DataFrame, keys: list[str], load_col: str = "load_seq") -> DataFrame:
    """Union of two archives; on equal keys the newer archive wins, other rows stay."""
    both = older.withColumn(load_col, F.lit(0).cast("bigint")).unionByName(
        newer.withColumn(load_col, F.lit(1).cast("bigint")), allowMissingColumns=True
    )
    return upsert_latest(both, keys, [load_col])


def mart_overwrite(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace the partitions present in df, keep all others: a rerun of a day is safe.

    Rows are rebalanced by partition: adaptive execution joins small partitions and splits large ones
    by their size, so a large day is no single task and a small one no swarm of files. Stores whose
    days are run apart need the store among the partitions.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def rows_to_json(df: DataFrame, keys: list[str], name: str = "raw") -> DataFrame:
    """Keep the key columns, serialize the whole row as JSON."""
    return df.select(*keys, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def rows_from_json(df: DataFrame, schema: str, name: str = "raw") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("_r")).select("_r.*")


def incremental_new_keys(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key the store does not hold yet."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")
