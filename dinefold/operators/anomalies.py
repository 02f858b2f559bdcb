"""Suspicious groups: too few items, too little revenue per guest, the same party twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B


def anomaly_few_items(groups: DataFrame) -> DataFrame:
    g, n = F.col("guests"), F.col("item_count")
    rule = F.when((g >= 5) & (n <= 3), "1a").when((g >= 3) & (n <= 2), "1b").when((g >= 2) & (n == 1), "1c")
    return groups.withColumn("few_items_rule", rule)


def anomaly_low_per_capita(groups: DataFrame) -> DataFrame:
    g, x, s = F.col("guests"), F.col("per_capita"), F.col("store")
    rule = (
        F.when((g >= 2) & (x < B.by_store(s, lambda p: p.low_2a)), "2a")
        .when((g >= 3) & (x < B.by_store(s, lambda p: p.low_2b)), "2b")
        .when((g >= 4) & (x < B.by_store(s, lambda p: p.low_2c)), "2c")
    )
    return groups.withColumn("low_rule", rule)


def with_previous_group(groups: DataFrame) -> DataFrame:
    """Add the previous group of the table.

    A table-day has at most 288 groups, since groups start at least five minutes apart, so the
    windows below are bounded: by a table-day, and by the days of a table for the carry-over.
    """
    end = F.coalesce("last_checkout", "last_time")
    fact = F.struct("first_time", "group_id", end.alias("end"), "item_count")
    table_day = ["store", "table_name", "biz_date"]
    last_of_day = groups.groupBy(*table_day).agg(F.max(fact).alias("last"))
    carried = last_of_day.select(
        *table_day, F.lag("last").over(W.partitionBy("store", "table_name").orderBy("biz_date")).alias("carried")
    )
    in_day = W.partitionBy(*table_day).orderBy("first_time", "group_id")
    out = groups.withColumn("_prev", F.lag(fact).over(in_day)).join(carried, table_day, "left")
    prev = F.coalesce("_prev", "carried")
    return out.withColumn("prev", prev).drop("_prev", "carried")


def anomaly_same_party(groups: DataFrame) -> DataFrame:
    gap = B.micros(F.col("first_time")) - B.micros(F.col("prev.end"))
    hit = (
        (gap <= P.SAME_PARTY_GAP_MINUTES * B.MINUTE_US)
        & (F.col("prev.item_count") >= 4)
        & (F.col("item_count") <= 2)
        & (F.col("guests") >= 3)
    )
    return with_previous_group(groups).withColumn("same_party_rule", F.when(hit, "3"))


def detect_anomalies(groups: DataFrame) -> DataFrame:
    """At most one rule per group, in the order of the rules, with its message."""
    g = anomaly_same_party(anomaly_low_per_capita(anomaly_few_items(groups)))
    rule = F.coalesce("few_items_rule", "low_rule", "same_party_rule")
    money = F.col("per_capita").cast("string")
    hm = lambda c: F.date_format(c, "HH:mm")
    # Message formats.
    message = (
        F.when(F.col("rule") == "1a", F.format_string("%d人仅%d件商品，请确认就餐人数", "guests", "item_count"))
        .when(F.col("rule") == "1b", F.format_string("%d人仅%d件商品，疑似人数多录", "guests", "item_count"))
        .when(F.col("rule") == "1c", F.format_string("%d人仅1件商品，请关注", "guests"))
        .when(F.col("rule") == "2a", F.format_string("人均仅¥%s（%d人），疑似人数多录或免单", money, "guests"))
        .when(F.col("rule") == "2b", F.format_string("人均仅¥%s（%d人）", money, "guests"))
        .when(F.col("rule") == "2c", F.format_string("人均仅¥%s（%d人），偏低", money, "guests"))
        .when(
            F.col("rule") == "3",
            F.format_string("疑似与前一桌（%s-%s）同一批客人", hm(F.col("prev.first_time")), hm(F.col("prev.end"))),
        )
    )
    return g.withColumn("rule", rule).withColumn("message", message)


def red_line(groups: DataFrame) -> DataFrame:
    limit = B.by_store(F.col("store"), lambda p: p.red_line)
    return groups.withColumn("red_line", F.coalesce(F.col("per_capita") < limit, F.lit(False)))


def anomaly_summary(groups: DataFrame) -> DataFrame:
    return detect_anomalies(groups).filter(F.col("rule").isNotNull())
