"""Streaming queries: run over all available data, then read what they wrote."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from dinefold.operators import cleaning as C
from dinefold.operators import sessions as S
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.out import plain
from dinefold.plans.prelude import CTES, oracle
from dinefold.session import scratch_dir, shuffles_dropped, stored
from dinefold.streaming import hourly, sessions, upsert


def stream_events(spark, sf):
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return R.base_events(files.parquet(sf))


def run_append(df, purpose):
    """Write an append-mode stream to files and read them back."""
    spark = df.sparkSession
    out = scratch_dir(spark, purpose)
    q = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", scratch_dir(spark, f"{purpose}-checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


# Results of a stream are those the watermark has closed: two hours behind the last event.
CTES["mark"] = "select max(ts) - interval 2 hour as t from ev"


@query("stream_upsert", oracle("select order_no, store, table_name, cast(revenue as double) as revenue from clean_o"))
def stream_upsert(spark, sf):
    path = scratch_dir(spark, "orders")
    keys, newest = ["order_no"], ["order_time"]
    orders = C.clean_orders(R.orders_from(stream_events(spark, sf)))
    # Twice from the start: the second run replays every batch and must change nothing.
    for run in range(2):
        q = upsert.stream_upsert(orders, path, scratch_dir(spark, "orders-checkpoint"), keys, newest)
        q.awaitTermination()
    out = upsert.read_latest(spark, path, keys, newest)
    return plain(out.select("order_no", "store", "table_name", "revenue"))


@query(
    "stream_takeaway_hourly",
    oracle(
        """select store, strftime(h, '%Y-%m-%d %H:%M:%S') as hour_start, n as n_orders, cast(r as double) as revenue from (
          select store, date_trunc('hour', ts) as h, count(*) as n, sum(value) as r from ev where k < 85 group by all) cross join mark
        where h + interval 3 hour <= mark.t"""
    ),
)
def stream_takeaway_hourly(spark, sf):
    """Every order arrives twice, first an hour early; ids here are unique per event."""
    e = stream_events(spark, sf)
    orders = R.takeaway_from(e).withColumn("takeaway_id", F.substring("serial_no", 2, 20))
    early = F.explode(F.array(F.lit(0), F.lit(1))).alias("early")
    twice = orders.select("*", early).withColumn("order_time", F.col("order_time") - F.make_dt_interval(hours="early")).drop("early")
    return plain(run_append(hourly.takeaway_hourly_stream(twice), "hourly"))


@query(
    "stream_sessions_r0",
    oracle(
        """select store, table_name, strftime(min(order_time), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n_orders,
          cast(sum(revenue) as double) as revenue from (
            select *, sum(new) over (partition by store, table_name order by order_time, order_no) as s from (
              select *, case when epoch_us(order_time) - epoch_us(lag(order_time) over (partition by store, table_name order by order_time, order_no))
                < 300000000 then 0 else 1 end as new from clean_o))
        group by store, table_name, s having max(order_time) + interval 299999999 microsecond <= (select t from mark)"""
    ),
)
def stream_sessions_r0(spark, sf):
    orders = C.clean_orders(R.orders_from(stream_events(spark, sf)))
    return plain(run_append(sessions.concurrent_sessions_stream(orders), "sessions"))


@query(
    "stream_session_merge",
    oracle("select store, table_name, strftime(biz_date, '%Y-%m-%d') as biz_date, order_no, group_no as group_id, decision from fold"),
)
def stream_session_merge(spark, sf):
    slots, out, kept = (scratch_dir(spark, x) for x in ("slots", "merged", "merged-orders"))
    with shuffles_dropped(spark):
        features = stored(S.order_features(R.items(spark, sf)), "features")
        orders = C.clean_orders(R.orders_from(stream_events(spark, sf)))
        # Orders meet their features once; the merge reads the orders that were kept with them.
        prepare = functools.partial(S.attach_features, features=features)
        sessions.stream_orders(orders, kept, scratch_dir(spark, "orders-checkpoint"), prepare).awaitTermination()
        prepared = sessions.kept_orders(spark, kept)
        sessions.stream_session_merge(prepared, slots, out, scratch_dir(spark, "merge-checkpoint")).awaitTermination()
        merged = sessions.read_merged(spark, out, kept)
    return plain(merged.select("store", "table_name", "biz_date", "order_no", "group_id", "decision"))
