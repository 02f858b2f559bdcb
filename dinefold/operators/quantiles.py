"""Exact order statistics of whole numbers per group, without a group's values in one task.

The value at a rank is found by narrowing: counts in wide buckets tell which bucket holds the rank, counts in
narrower ones within it, down to single values. Each round is a plain aggregate; only as many counts as a bucket
has narrower ones are ever in order beside each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Widths of the buckets for microseconds: a minute, four milliseconds, one.
WIDTHS = (60_000_000, 4_000, 1)


def values_at(counted: DataFrame, ranks: DataFrame, by: list[str], widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(by, rank, value): the value at each rank from 0 of its group.

    counted: (by, value, n), a value may come several times. ranks: (by, rank), all below the group's sum of n.
    Null group values are a group like any other. Each width divides the one before, the last is 1.
    """
    if widths[-1] != 1 or any(a % b for a, b in zip(widths, widths[1:])):
        raise ValueError("widths divide each other, down to 1")
    group = {c: f"_{c}" for c in by}
    left = counted.filter("value is not null and n > 0").withColumnsRenamed(group)
    wanted = ranks.select(*by, "rank", F.col("rank").alias("rest"), F.lit(None).cast("bigint").alias("bucket"))
    wide = None
    for width in widths:
        counts = left.groupBy(*group.values(), _floor_div(F.col("value"), width).alias("_bucket")).agg(F.sum("n").alias("n"))
        same = _same(by)
        if wide is not None:
            same = same & (_floor_div(F.col("_bucket"), wide // width) == F.col("bucket"))
        # Counts of one bucket of the last round, for each rank asked for.
        order = W.partitionBy(*by, "rank").orderBy("_bucket")
        held = wanted.join(counts, same).withColumn("upto", F.sum("n").over(order))
        held = held.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        wanted = held.select(*by, "rank", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), F.col("_bucket").alias("bucket"))
        wide = width
    return wanted.select(*by, "rank", F.col("bucket").alias("value"))


def _floor_div(c: Column, by: int) -> Column:
    """Whole division that rounds down, in whole numbers."""
    return F.call_function("div", c - F.pmod(c, F.lit(by)), F.lit(by))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def marks(counted: DataFrame, by: list[str], shares: dict[str, float], widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(by, one column per share): the value at the share of each group, between the two nearest ranks by their distance."""
    total = counted.filter("value is not null").groupBy(*by).agg(F.sum("n").alias("total")).filter("total > 0")
    asked = F.array(*[F.struct(F.lit(name).alias("mark"), F.lit(float(q)).alias("share")) for name, q in shares.items()])
    at = F.col("share") * (F.col("total") - 1)
    places = total.select(*by, "total", F.inline(asked)).withColumn("low", F.floor(at).cast("bigint")).withColumn("part", at - F.col("low"))
    ends = places.select(*by, "mark", "part", F.explode(F.array_distinct(F.array("low", F.least(F.col("low") + 1, F.col("total") - 1)))).alias("rank"), "low")
    found = values_at(counted, ends.select(*by, "rank").distinct(), by, widths).withColumnsRenamed({c: f"_{c}" for c in [*by, "rank"]})
    both = ends.join(found, _same([*by, "rank"]))
    first = F.max(F.when(F.col("rank") == F.col("low"), F.col("value")))
    last = F.max("value")
    value = both.groupBy(*by, "mark", "part").agg((first + (last - first) * F.col("part")).alias("value"))
    return value.groupBy(*by).agg(*[F.max(F.when(F.col("mark") == name, F.col("value"))).alias(name) for name in shares])
