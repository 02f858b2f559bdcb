"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so a batch holds few of them; a text over the
#: bound makes a batch of its own.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: Bits of the filter that keeps rows without a partner out of a join.
FILTER_BITS = 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes that go to a Python worker at once; the settings stay with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def ascii_lower(text: str | Column) -> Column:
    """A-Z only; every other letter stays as it is."""
    return F.translate(text, UPPER, LOWER)


def in_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function from one record batch to a dict of columns (or None for no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_key(text: str = "text") -> Column:
    """16 bytes of a text's SHA-256, by which equal texts meet; null for null."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def _place(key: str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).cast("int")


def key_filter(keys: DataFrame) -> DataFrame:
    """(word, bits): a bitmap with one bit set for each `key`, at most FILTER_BITS / 32 rows whatever the data."""
    bit = keys.select(_place().alias("bit"))
    return bit.groupBy(F.expr("bit div 32").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits"))


def may_hold(rows: DataFrame, bitmap: DataFrame, wanted: bool) -> DataFrame:
    """Rows whose `key` may be among the filter's keys, or those whose key surely isn't."""
    placed = rows.withColumn("bit", _place()).withColumn("word", F.expr("bit div 32").cast("int"))
    # The bitmap's size is bounded by a constant, a few MB.
    hit = placed.join(F.broadcast(bitmap), "word", "left").withColumn("hit", F.expr("shiftright(coalesce(bits, 0L), bit % 32) & 1L") == 1)
    return hit.where(F.col("hit") == wanted).select(*rows.columns)
