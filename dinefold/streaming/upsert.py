"""Incremental upsert of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dinefold.sources.keyed import KeyedStore

LOAD = "load_batch"
EVENT_TIME = "event_time"


def with_event_time(stream: DataFrame, delay: str, column: str = "order_time") -> DataFrame:
    """Watermark on the order time. Streams need an instant, so the session zone must be UTC."""
    return stream.withColumn(EVENT_TIME, F.col(column).cast("timestamp")).withWatermark(EVENT_TIME, delay)


def append_batch(batch: DataFrame, batch_id: int, path: str, within: list[str] = ()) -> None:
    """Write one micro-batch as its own partition, or one in each partition of `within`. A replayed batch
    replaces itself."""
    (
        batch.withColumn(LOAD, F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*within, LOAD)
        .parquet(path)
    )


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], newest: list[str], buckets: int = 16
) -> StreamingQuery:
    """Keep the latest row per key in a `KeyedStore`: the last micro-batch of a key wins, then the newest columns.

    A store belongs to one stream: batches are known by their numbers, and one that was loaded is left out.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(batch.sparkSession, path, keys, newest, buckets).load(batch, batch_id)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str], newest: list[str]) -> DataFrame:
    """The store as of now."""
    return KeyedStore(spark, path, keys, newest).read()
