"""Global shuffle into shards in two passes over external storage.

Pass one scatters whole records into memory-sized buckets by a seeded hash of the id. Pass two takes
one bucket at a time, permutes it by a seeded Fisher-Yates shuffle and writes it. Where a bucket
starts in the global order is known from the counts of the buckets, so every record gets its final
shard and slot without another pass. Law `rows`: shard s holds the positions from ceil(s * n / shards)
on, so that counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dinefold.llm.common import small_batches
from dinefold.session import scratch_dir

#: UTF-8 bytes of text that one bucket holds on average; a bucket is permuted in memory.
BUCKET_BYTES = 16 << 20


def record_size(text_col: str = "text") -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of range(n). Every swap partner is drawn at once, then the swaps are made."""
    order = list(range(n))
    draws = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_to_shards(df: DataFrame, path: str, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write df below path, one folder per shard, and return the written records with shard and slot.

    Columns of df that clash with shard, slot, bucket or position are kept under their name with a
    leading `in_`. A null text counts as empty, a null id is scattered by its text. Ids are meant to be
    unique; rows that repeat an id share a bucket. An empty table writes an empty result.
    """
    spark = small_batches(df.sparkSession)
    clash = {"shard", "slot", "_bucket", "_start"} & set(df.columns)
    df = df.withColumnsRenamed({c: f"in_{c}" for c in clash})
    n, total = df.agg(F.count(F.lit(1)), F.sum(record_size(text_col))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), text_col)).otherwise(F.xxhash64(F.lit(seed), id_col))
    scattered = df.withColumn("_bucket", F.pmod(key, F.lit(buckets)))

    # One row of two integers per bucket; the running sum gives the first position of each.
    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("rows"))
    starts = counts.select("_bucket", (F.sum("rows").over(Window.orderBy("_bucket")) - F.col("rows")).alias("_start"))
    out = StructType([*df.schema.fields, StructField("shard", LongType()), StructField("slot", LongType())])

    def one_bucket(records: pa.Table) -> pa.Table:
        records = records.sort_by(id_col)
        bucket, start = records["_bucket"][0].as_py(), records["_start"][0].as_py()
        records = records.drop_columns(["_bucket", "_start"]).take(fisher_yates(records.num_rows, seed * 1_000_003 + bucket))
        position = np.arange(start, start + records.num_rows)
        shard = position * shards // n
        return records.append_column("shard", pa.array(shard)).append_column("slot", pa.array(position - -(-shard * n // shards)))

    written = scattered.join(starts, "_bucket").groupBy("_bucket").applyInArrow(one_bucket, out)
    written.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out).parquet(path)


def shard_report(df: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """Shuffle df into shards and describe what the shard files hold."""
    back = shuffle_to_shards(df.select("doc_id", "text"), scratch_dir(df.sparkSession, "shards"), shards, seed)
    return back.select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
