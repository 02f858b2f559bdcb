"""Streams over several files equal the batch operators."""

from __future__ import annotations

import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from dinefold.operators import sessions as S
from dinefold.session import shuffles_dropped
from dinefold.streaming import sessions as ST
from dinefold.streaming.hourly import takeaway_hourly_stream
from dinefold.streaming import upsert as U
from tests.helpers import frames, random_case


def file_stream(spark, df, path, n, by):
    """df written as n files in time order, read one file per micro-batch."""
    rows = df.count()
    ranked = df.orderBy(by).toPandas()
    step = rows // n + 1
    for i in range(n):
        spark.createDataFrame(ranked[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def streamed(spark, o, i, tmp_path, stream):
    slots, out = str(tmp_path / "slots"), str(tmp_path / "out")
    prepared = S.attach_features(stream, S.order_features(i))
    ST.stream_session_merge(prepared, slots, out, str(tmp_path / "check"), delay="30 minutes").awaitTermination()
    ST.stream_orders(prepared, str(tmp_path / "orders"), str(tmp_path / "check2")).awaitTermination()
    got = ST.read_merged(spark, out, str(tmp_path / "orders")).select("order_no", "group_id", "decision")
    batch = S.session_merge(o, i).select("order_no", "group_id", "decision")
    return sorted(got.collect()), sorted(batch.collect())


def test_session_merge_stream_equals_batch(spark, tmp_path):
    o, i = frames(spark, *random_case(31, 150))
    got, want = streamed(spark, o, i, tmp_path, file_stream(spark, o, str(tmp_path / "in"), 5, "order_time"))
    assert got == want and len(got) > 20 and "R0" in {r["decision"] for r in got}


def test_late_orders_keep_their_group(spark, tmp_path):
    """Orders that come days late: alone in their slot, in a slot that is closed, and before a group's first order."""
    o, i = frames(spark, *random_case(32, 120))
    orders = sorted(o.collect(), key=lambda r: r["order_time"])
    late = orders[3::9]
    path = str(tmp_path / "in")
    for part in ([r for r in orders if r not in late][:60], [r for r in orders if r not in late][60:], late):
        spark.createDataFrame(part, o.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, want = streamed(spark, o, i, tmp_path, stream)
    assert got == want and {r["order_no"] for r in late} <= {r["order_no"] for r in got}


def test_merge_holds_its_slots_by_day_alone(spark, tmp_path):
    """No state store beside the slots, no statistics that nothing reads, and late orders are in the slots too."""
    o, i = frames(spark, *random_case(33, 120))
    orders = sorted(o.collect(), key=lambda r: r["order_time"])
    for part in ([r for r in orders if r not in orders[3::9]], orders[3::9]):
        spark.createDataFrame(part, o.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, want = streamed(spark, o, i, tmp_path, stream)
    assert got == want
    assert not os.path.exists(tmp_path / "check" / "state")
    slots = spark.read.parquet(str(tmp_path / "slots"))
    assert slots.select("part.*").columns == ["n_all"]
    assert slots.agg(F.sum("part.n_all")).first()[0] == len(orders)
    # The mart has the slots that the latest order has closed, and no other.
    mark = orders[-1]["order_time"] - timedelta(minutes=30)
    keys = ["store", "table_name", "biz_date", "slot"]
    counts = S.with_slots(o).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"), F.min("order_time").alias("t"))
    begun = F.date_trunc("hour", "t") + F.make_dt_interval(mins=F.floor(F.minute("t") / 5).cast("int") * 5 + 5)
    closed = counts.filter(begun <= F.lit(str(mark)).cast("timestamp_ntz")).select(*keys, "n_all")
    out = spark.read.parquet(str(tmp_path / "out")).select(*keys, "n_all")
    assert sorted(out.collect()) == sorted(closed.collect()) and 0 < closed.count() < counts.count()


def test_orders_prepared_by_trigger_feed_the_merge(spark, tmp_path):
    """Orders meet their features in the stream that keeps them; the merge streams from there, in several runs."""
    o, i = frames(spark, *random_case(34, 90))
    features, kept = S.order_features(i), str(tmp_path / "kept")
    orders = sorted(o.collect(), key=lambda r: r["order_time"])
    for part in (orders[:40], orders[40:]):
        spark.createDataFrame(part, o.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(o.schema).parquet(str(tmp_path / "in"))
        ST.stream_orders(stream, kept, str(tmp_path / "check1"), lambda rows: S.attach_features(rows, features)).awaitTermination()
        prepared = ST.kept_orders(spark, kept)
        ST.stream_session_merge(prepared, str(tmp_path / "slots"), str(tmp_path / "out"), str(tmp_path / "check2")).awaitTermination()
    got = ST.read_merged(spark, str(tmp_path / "out"), kept).select("order_no", "group_id", "decision")
    assert sorted(got.collect()) == sorted(S.session_merge(o, i).select("order_no", "group_id", "decision").collect())


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    blocks = lambda: {str(b) for b in disk.getAllBlocks().mkString(" ").split(" ") if b.startswith("shuffle_")}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, key = blocks(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        spark.range(1000).groupBy(F.col("id") % 7).count().write.parquet(str(tmp_path / "out"))
        until = time.time() + 20
        while blocks() - before and time.time() < until:
            time.sleep(0.2)
    assert not blocks() - before and spark.conf.get(key) == "false"


def test_return_within_the_delay_lowers_the_hour(spark, tmp_path):
    schema = "store string, source string, takeaway_id string, serial_no string, order_time timestamp_ntz, status string, revenue int"
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [
        ("s", "a", "1", "#1", at(10, 5), "已完成", 30), ("s", "a", "2", "#1", at(10, 10), "已完成", 20),
        ("s", "a", "1", "#2", at(10, 5), "已退单", 30), ("s", "a", "2", "#1", at(10, 10), "已完成", 20),
        ("s", "a", "-", "#1", at(10, 20), "已完成", 99), ("s", "a", "9", "#1", at(18, 0), "已完成", 1),
        # An order whose time moves over the hour counts once, where its latest row is.
        ("s", "a", "3", "#1", at(10, 58), "已完成", 5), ("s", "a", "3", "#1", at(11, 2), "已完成", 7),
    ]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = takeaway_hourly_stream(stream).writeStream.outputMode("append").format("parquet")
    out = out.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    out.start(str(tmp_path / "out")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == [("s", at(10, 0), 1, 20), ("s", at(11, 0), 1, 7)]


def test_upsert_replay_and_newer_rows(spark, tmp_path):
    """The last batch wins over newer columns of an earlier one; a second stream over the same files changes nothing."""
    schema = "k string, v int, t int"
    for part in ([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], [("b", 9, 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "store")
    for run in range(2):
        U.stream_upsert(stream, path, str(tmp_path / f"check{run}"), ["k"], ["t"], buckets=2).awaitTermination()
        out = U.read_latest(spark, path, ["k"], ["t"])
        assert sorted(out.select("k", "v").collect()) == [("a", 2), ("b", 9)]
