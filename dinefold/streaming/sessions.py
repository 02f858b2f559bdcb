"""The consumption-group merge on a stream.

The orders of a trigger become slots (see `operators.sessions`) by the batch aggregate, combined on the map side, so a hot
table is no hot task. Slots are appended to a store by day. That store is the state: memory does not grow with the slots that
are open, nor with the orders of a trigger. A slot is closed when the latest order of the store is the delay behind its
end. The days in which slots came or closed are folded again by the batch operator, which gives the batch result without
a second implementation. A second stream without state keeps the orders themselves; reading joins both. Where a slot's count of
orders is not that of the orders kept, because the slot is still open or one stream is ahead of the other, the table-day is
folded from the orders, so every order has the group that the batch gives it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dinefold.functions.business import MINUTE_US
from dinefold.operators.sessions import DAY, build_slots, fold_slots
from dinefold.params import MergeParams
from dinefold.session import stored
from dinefold.sources.store import mart_overwrite
from dinefold.streaming.upsert import EVENT_TIME, LOAD, append_batch, with_event_time

# Orders less than five minutes apart share a session. Session windows also join where they
# touch, so the gap is one microsecond short of five minutes.
R0_GAP = "4 minutes 59.999999 seconds"


def concurrent_sessions_stream(orders: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Sessions of concurrent orders per table."""
    return (
        with_event_time(orders, delay)
        .groupBy("store", "table_name", F.session_window(EVENT_TIME, R0_GAP).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("revenue").alias("revenue"))
        .select("store", "table_name", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n_orders", "revenue")
    )


def slots_of(prepared: DataFrame) -> DataFrame:
    """Slots of prepared orders, with their count in place of the statistics of groups."""
    return build_slots(prepared, statistics=[F.count(F.lit(1)).alias("n_all")])


def unite_slots(slots: DataFrame) -> DataFrame:
    """One row per slot of those that several triggers brought.

    Rows are dealt out by table-day, at most 288 of a trigger, so the fold that follows needs no second exchange.
    """
    merged = [F.min("head").alias("head"), F.max("tail").alias("tail"), F.struct(F.sum("part.n_all").alias("n_all")).alias("part")]
    return slots.repartition(*DAY).groupBy(*DAY, "slot").agg(*merged)


def slot_end(p: MergeParams) -> Column:
    """The end of a slot in microseconds."""
    in_day = F.lit(p.cutover_hour * 60) + (F.col("slot") + 1) * p.concurrent_minutes
    return (F.unix_date("biz_date").cast("bigint") * (24 * 60) + in_day) * MINUTE_US


def fold_batch(batch: DataFrame, batch_id: int, slots_path: str, out_path: str, p: MergeParams, delay: str) -> None:
    """Store the slots of a trigger, then fold the closed slots of the touched days anew and replace those days.

    The batch is evaluated once; the touched days are those written and those in which a slot was open, and only their
    partitions are folded.
    """
    spark, slots = batch.sparkSession, slots_of(batch)
    append_batch(slots, batch_id, slots_path, within=["biz_date"])
    kept = spark.read.schema(T.StructType([*slots.schema, T.StructField(LOAD, T.LongType())])).parquet(slots_path)
    new, latest = F.col(LOAD) == batch_id, F.col("tail.t_us")
    days = kept.groupBy("biz_date").agg(
        F.bool_or(new).alias("new"), F.max(slot_end(p)).alias("end"), F.max(latest).alias("latest"), F.max(F.when(~new, latest)).alias("before")
    ).collect()  # one row per day
    if not any(d["new"] for d in days):
        return
    back = spark.sql(f"select unix_micros(timestamp_seconds(0) + interval {delay})").first()[0]
    mark = max(d["latest"] for d in days) - back
    known = max((d["before"] for d in days if d["before"] is not None), default=mark) - back
    touched = [d["biz_date"] for d in days if d["new"] or d["end"] > known]
    closed = kept.filter(F.col("biz_date").isin(touched) & (slot_end(p) <= mark))
    folded = fold_slots(unite_slots(closed), p)
    mart_overwrite(folded.select(*DAY, "slot", "group_id", "part.n_all", "step.order_no", "step.decision"), out_path, ["biz_date"])


def stream_session_merge(
    prepared: DataFrame, slots_path: str, out_path: str, checkpoint: str, p: MergeParams = MergeParams(), delay: str = "2 hours"
) -> StreamingQuery:
    """Fold closed slots: one row per slot with its group and the decision on its first order."""
    return (
        prepared.writeStream.foreachBatch(lambda df, i: fold_batch(df, i, slots_path, out_path, p, delay))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_orders(
    orders: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda orders: orders
) -> StreamingQuery:
    """Keep every prepared order, by day. Orders that are not yet prepared are so trigger by trigger, as batches."""
    return (
        orders.writeStream.foreachBatch(lambda df, i: append_batch(prepare(df), i, path, within=["biz_date"]))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_orders(spark: SparkSession, path: str) -> DataFrame:
    """The prepared orders that `stream_orders` has kept, as a stream.

    A trigger that is done again writes new files. If they are streamed twice, slots count more orders than are kept, and
    reading folds those table-days from the orders.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).drop(LOAD)


def read_merged(spark: SparkSession, out_path: str, orders_path: str, p: MergeParams = MergeParams()) -> DataFrame:
    """Every order that has arrived with its group and decision, as `session_merge` over all of them gives it."""
    key = [*DAY, "slot"]
    slots = spark.read.parquet(out_path)
    orders = spark.read.parquet(orders_path).drop(LOAD)
    arrived = orders.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    behind = arrived.join(slots.select(*key, "n_all"), key, "left").filter(~F.col("n_all").eqNullSafe(F.col("n")))
    behind = stored(behind.select(*DAY).distinct(), "behind")
    days = [r["biz_date"] for r in behind.select("biz_date").distinct().collect()]
    late = orders.filter(F.col("biz_date").isin(days)).join(behind, DAY, "left_semi")
    again = fold_slots(build_slots(late, statistics=False), p).select(*key, "group_id", "step.order_no", "step.decision")
    heads = slots.select(*again.columns).join(behind, DAY, "left_anti").unionByName(again)
    heads = heads.withColumnsRenamed({"order_no": "head_no", "decision": "head_decision"})
    decision = F.when(F.col("order_no") == F.col("head_no"), F.col("head_decision")).otherwise("R0")
    return orders.select("order_no", *key).join(heads, key).select("order_no", *DAY, "group_id", decision.alias("decision"))
