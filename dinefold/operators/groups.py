"""Consumption groups: statistics, filter status and the order-count funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.functions.cells import is_digit_id
from dinefold.operators.cleaning import clean_orders, is_dine_in, is_pickup
from dinefold.operators.sessions import DAY, build_slots, fold_slots, group_partials, prepare_orders
from dinefold.params import MergeParams


def drop_free_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("revenue") > 0)


def aggregate_groups(orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Groups of clean orders. Built from slot statistics, so orders are never joined back."""
    folded = fold_slots(build_slots(prepare_orders(orders, items, p)), p)
    return _finish(folded.select(*DAY, "group_id", "part.*"))


def groups_from_merged(merged: DataFrame) -> DataFrame:
    """The same groups from stored rows of `session_merge(..., features=True)`."""
    parts = merged.groupBy(*DAY, "group_id").agg(F.struct(*group_partials()).alias("part"))
    return _finish(parts.select(*DAY, "group_id", "part.*"))


def _finish(parts: DataFrame) -> DataFrame:
    g = parts.groupBy(*DAY, "group_id").agg(
        F.sum("n_all").alias("n_all"),
        F.sum("n_orders").alias("n_orders"),
        F.sum("revenue").cast("decimal(18,2)").alias("revenue"),
        F.sum("amount").cast("decimal(18,2)").alias("amount"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.max("last_checkout").alias("last_checkout"),
        F.max("top_order")["guests"].alias("guests"),
        F.min("first_opener")["opener"].alias("opener"),
        F.sum("item_count").alias("item_count"),
        F.sum("snack_lines").alias("snack_lines"),
        F.sum("packing_lines").alias("packing_lines"),
        F.bool_or("member").alias("member"),
    )
    # Groups of free orders only vanish.
    g = g.filter(F.col("n_orders") > 0)
    g = g.withColumn("per_capita", B.per_capita(F.col("revenue"), F.col("guests")))
    return (
        g.withColumn("filter_status", filter_status())
        .withColumn("area", B.area_class(F.col("store"), F.col("table_name")))
        .withColumn("daypart", B.daypart(F.col("first_time")))
    )


def filter_status():
    """First reason that keeps a group out of the statistics, else 'kept'."""
    only = lambda c: (F.col("item_count") > 0) & (F.col(c) == F.col("item_count"))
    stray = (F.col("guests") == 1) & (F.col("item_count") == 1) & (F.col("revenue") < 100)
    return (
        F.when(F.coalesce(F.col("per_capita") <= 0, F.lit(True)), "no_per_capita")
        .when(only("snack_lines"), "snack")
        .when(only("packing_lines"), "packing")
        .when(stray, "stray")
        .when(F.col("table_name").contains(P.BAR_TABLE), "bar")
        .otherwise("kept")
    )


def kept(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("filter_status") == "kept")


def order_count_funnel(raw_orders: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """From raw orders down to counted groups; every step is a column, and the steps add up.

    A dine-in order is invalid if its number is not digits alone, or its revenue or time can't be read.
    """
    dine_in = is_dine_in() & ~is_pickup()
    readable = is_digit_id(F.col("order_no")) & F.col("revenue").isNotNull() & F.col("order_time").isNotNull()
    clean = dine_in & readable
    before = (
        raw_orders.withColumn("group_date", F.col("order_time").cast("date"))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("raw_orders"),
            F.count_if(is_pickup()).alias("takeaway_orders"),
            F.count_if(~is_dine_in() & ~is_pickup()).alias("not_dine_in_orders"),
            F.count_if(dine_in & ~readable).alias("invalid_orders"),
            F.count_if(clean & (F.col("revenue") <= 0)).alias("free_orders"),
            F.count_if(clean & (F.col("revenue") > 0)).alias("paid_orders"),
        )
    )
    status = lambda s: F.count_if(F.col("filter_status") == s)
    after = (
        groups.withColumnRenamed("biz_date", "group_date")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("merged_groups"),
            status("no_per_capita").alias("no_per_capita_groups"),
            status("snack").alias("snack_groups"),
            status("packing").alias("packing_groups"),
            status("stray").alias("stray_groups"),
            status("bar").alias("bar_groups"),
            status("kept").alias("counted_groups"),
        )
    )
    counts = [c for c in after.columns if c not in by]
    out = before.join(after, by, "full")
    for c in [*[x for x in before.columns if x not in by], *counts]:
        out = out.withColumn(c, F.coalesce(c, F.lit(0).cast("bigint")))
    return out.withColumn("merged_away", F.col("paid_orders") - F.col("merged_groups")).drop("paid_orders")


def groups_of(raw_orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Clean, merge and aggregate in one go."""
    return aggregate_groups(clean_orders(raw_orders), items, p)
