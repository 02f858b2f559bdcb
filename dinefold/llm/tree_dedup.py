"""Exact dedup by a tree merge of sorted digest runs.

Every input partition is one run of (digest, smallest or largest id, rows). Runs are merged in
binomial rounds: in a round, `fanout` (a power of two) neighbouring runs meet, equal digests become
one entry, and the entry keeps the winning id. The winners of the last round go back down the same
tree, so that a join never sees more than one row of a digest and run above the leaves, and at the
leaves no more than the copies that one input partition holds. A text that makes up a third of all
rows is therefore never gathered by one key.

A digest is verified: entries are equal only if SHA-256, byte length and a second, independent
64-bit hash agree. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import ascii_lower
from dinefold.session import stored

#: What must agree for two texts to count as equal.
SAME = ["_digest", "_bytes", "_check"]


def leaf_runs(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """One row per input row: its run, its row number (row_col, or given here) and what identifies its text."""
    text = F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8")
    return df.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"),
        F.spark_partition_id().alias("_run"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.octet_length(text).cast("long").alias("_bytes"),
        F.xxhash64(text).alias("_check"),
    )


def _merged(runs: DataFrame, bits: int, best) -> DataFrame:
    """One round: runs whose number agrees above the lowest `bits` bits become one sorted run."""
    parent = F.shiftright("_run", bits) if bits else F.col("_run")
    return (
        runs.groupBy(parent.alias("_run"), *SAME)
        .agg(best("_win").alias("_win"), F.sum("_rows").alias("_rows"))
        .sortWithinPartitions("_run", "_digest")
    )


def tree_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fanout: int = 16, row_col: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of df.

    keep: `min` or `max`, which id of equal texts stays. Null texts count as empty. Rows that repeat
    an id and its text are copies like any other: one of them is kept. A null id loses against any
    other id. An empty table gives no rows; other columns of df, whatever their names, are not read.
    """
    if fanout < 2 or fanout & (fanout - 1):
        raise ValueError("fanout must be a power of two")
    bits = fanout.bit_length() - 1
    best = {"min": F.min, "max": F.max}[keep]
    leaves = stored(leaf_runs(df, id_col, text_col, row_col), "digest-runs")
    last_run = leaves.agg(F.max("_run")).first()[0] or 0
    rounds = math.ceil(math.log(last_run + 1, fanout) - 1e-9) if last_run else 0

    # Nulls sort first in Spark: mark them so that they lose in either direction.
    null_last = F.col("_id").isNull() if keep == "min" else F.col("_id").isNotNull()
    levels = [_merged(leaves.select("_run", *SAME, F.struct(null_last.alias("n"), "_id", "_row").alias("_win"), F.lit(1).cast("long").alias("_rows")), 0, best)]
    for _ in range(rounds):
        levels.append(_merged(levels[-1], bits, best))

    winners = levels[-1]
    for below in reversed(levels[:-1]):
        known = winners.withColumnRenamed("_run", "_parent")
        step = below.select(F.shiftright("_run", bits).alias("_parent"), "_run", *SAME)
        winners = step.join(known, ["_parent", *SAME]).drop("_parent")
    return leaves.join(winners, ["_run", *SAME]).select(
        F.col("_id").alias("doc_id"),
        F.col("_win._id").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        (F.col("_row") == F.col("_win._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        "_row",
    )


ORACLE = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
      from documents)
window g as (partition by text_sha256)
"""
