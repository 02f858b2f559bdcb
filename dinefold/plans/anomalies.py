"""Queries of the anomaly rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinefold.operators import anomalies as A
from dinefold.operators import groups as G
from dinefold.plans.catalog import query
from dinefold.plans.merge import groups
from dinefold.plans.out import plain
from dinefold.plans.prelude import CTES, oracle
from dinefold.session import stored

CTES["anom"] = """
  select *, case when guests >= 5 and item_count <= 3 then '1a' when guests >= 3 and item_count <= 2 then '1b'
      when guests >= 2 and item_count = 1 then '1c' end as r1,
    case when store = '保利店' then case when guests >= 2 and per_capita < 15 then '2a' end
      else case when guests >= 2 and per_capita < 10 then '2a' when guests >= 3 and per_capita < 20 then '2b'
        when guests >= 4 and per_capita < 30 then '2c' end end as r2,
    case when epoch_us(first_time) - epoch_us(prev_end) <= 5400000000 and prev_items >= 4 and item_count <= 2 and guests >= 3
      then '3' end as r3
  from (select *, lag(item_count) over w as prev_items, lag(first_time) over w as prev_start,
      lag(coalesce(last_checkout, last_time)) over w as prev_end
    from kept window w as (partition by store, table_name order by first_time, group_id))"""
CTES["found"] = """
  select *, coalesce(r1, r2, r3) as rule, case coalesce(r1, r2, r3)
    when '1a' then concat(guests, '人仅', item_count, '件商品，请确认就餐人数')
    when '1b' then concat(guests, '人仅', item_count, '件商品，疑似人数多录')
    when '1c' then concat(guests, '人仅1件商品，请关注')
    when '2a' then concat('人均仅¥', per_capita, '（', guests, '人），疑似人数多录或免单')
    when '2b' then concat('人均仅¥', per_capita, '（', guests, '人）')
    when '2c' then concat('人均仅¥', per_capita, '（', guests, '人），偏低')
    when '3' then concat('疑似与前一桌（', strftime(prev_start, '%H:%M'), '-', strftime(prev_end, '%H:%M'), '）同一批客人') end as message
  from anom"""


def counted(spark, sf):
    return G.kept(groups(spark, sf))


def counted_once(spark, sf):
    """Counted groups as a table, for reports that read them more than once."""
    return stored(counted(spark, sf), "groups")


@query("anomaly_few_items", oracle("select group_id, guests, item_count, r1 as few_items_rule from anom"))
def anomaly_few_items(spark, sf):
    return A.anomaly_few_items(counted(spark, sf)).select("group_id", "guests", "item_count", "few_items_rule")


@query("anomaly_low_per_capita", oracle("select group_id, guests, cast(per_capita as double) as per_capita, r2 as low_rule from anom"))
def anomaly_low_per_capita(spark, sf):
    return plain(A.anomaly_low_per_capita(counted(spark, sf)).select("group_id", "guests", "per_capita", "low_rule"))


@query("anomaly_same_party", oracle("select group_id, prev_items, strftime(prev_end, '%Y-%m-%d %H:%M:%S') as prev_end, r3 as same_party_rule from anom"))
def anomaly_same_party(spark, sf):
    out = A.anomaly_same_party(counted_once(spark, sf))
    return plain(out.select("group_id", F.col("prev.item_count").alias("prev_items"), F.col("prev.end").alias("prev_end"), "same_party_rule"))


@query("detect_anomalies", oracle("select group_id, rule, message from found"))
def detect_anomalies(spark, sf):
    return A.detect_anomalies(counted_once(spark, sf)).select("group_id", "rule", "message")


@query(
    "red_line",
    oracle("select group_id, store, per_capita < case when store = '保利店' then 40 else 100 end as red_line from kept"),
)
def red_line(spark, sf):
    return A.red_line(counted(spark, sf)).select("group_id", "store", "red_line")


@query(
    "anomaly_summary",
    oracle(
        """select table_name, guests, item_count, cast(per_capita as double) as per_capita, group_id, message
        from found where rule is not null"""
    ),
)
def anomaly_summary(spark, sf):
    out = A.anomaly_summary(counted_once(spark, sf))
    return plain(out.select("table_name", "guests", "item_count", "per_capita", "group_id", "message").orderBy("table_name", "group_id"))
