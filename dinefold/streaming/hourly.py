"""Hourly takeaway mart over a stream with late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.functions.cells import is_digit_id
from dinefold.operators.takeaway import KEY, valid_orders
from dinefold.streaming.upsert import EVENT_TIME, with_event_time


def takeaway_hourly_stream(orders: DataFrame, delay_hours: int = 2) -> DataFrame:
    """Orders and revenue per store and hour; an hour is emitted once its lateness is over.

    As in the batch, the latest row of an order counts, with its hour: an order that is returned, or whose time moves to
    another hour, leaves the earlier row's hour. The first state is keyed by order and holds the rows that follow each
    other within the delay, a session; the second is keyed by store and hour. A session ends the delay and
    a microsecond after its latest row, so the time of its window is the latest row's and the delay, whole hours.
    """
    known = with_event_time(orders.filter(is_digit_id(F.col("takeaway_id"))), f"{delay_hours} hours")
    latest = known.groupBy(*KEY, F.session_window(EVENT_TIME, f"{delay_hours} hours 1 microsecond").alias("w")).agg(
        F.max(F.struct("order_time", "serial_no", "status", "revenue")).alias("last")
    )
    return (
        valid_orders(latest.select(*KEY, F.window_time("w").alias("closed"), "last.status", "last.revenue"))
        .groupBy("store", F.window("closed", "1 hour").alias("h"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("revenue").alias("revenue"))
        .select("store", (F.col("h.start") - F.make_dt_interval(hours=F.lit(delay_hours))).cast("timestamp_ntz").alias("hour_start"), "n_orders", "revenue")
    )
