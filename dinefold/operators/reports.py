"""Report tables over consumption groups, items and visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.operators.anomalies import red_line

ALL = "全部"


def _label(c: str) -> Column:
    return F.when(F.grouping(c) == 1, F.lit(ALL)).otherwise(F.col(c)).alias(f"{c}_label")


def overview(groups: DataFrame, by: list[str]) -> DataFrame:
    """Revenue, share of the parent level, guests and per-capita: total, area, daypart, daypart by area."""
    sets = [by, [*by, "area"], [*by, "daypart"], [*by, "daypart", "area"]]
    levels = groups.groupingSets(sets, *by, "daypart", "area").agg(
        _label("daypart"),
        _label("area"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("revenue").alias("revenue"),
        F.sum("guests").cast("bigint").alias("guests"),
    )
    levels = levels.drop("daypart", "area").withColumnsRenamed({"daypart_label": "daypart", "area_label": "area"})
    # Windows over the few rows of one report: dayparts times areas.
    total = F.max(F.when((F.col("daypart") == ALL) & (F.col("area") == ALL), F.col("revenue"))).over(W.partitionBy(*by))
    part = F.max(F.when(F.col("area") == ALL, F.col("revenue"))).over(W.partitionBy(*by, "daypart"))
    parent = F.when((F.col("daypart") != ALL) & (F.col("area") != ALL), part).otherwise(total)
    return levels.withColumn("share", B.ratio(F.col("revenue"), parent)).withColumn(
        "per_capita", B.ratio(F.col("revenue"), F.col("guests"))
    )


def member_split(groups: DataFrame, by: list[str]) -> DataFrame:
    out = groups.groupBy(*by, "member").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("revenue").alias("revenue"),
        F.sum("guests").cast("bigint").alias("guests"),
    )
    return out.withColumn("per_capita", B.ratio(F.col("revenue"), F.col("guests")))


def price_buckets(groups: DataFrame, by: list[str]) -> DataFrame:
    """Groups and share per band; empty bands show 0 since every band is its own aggregate."""
    band = B.price_band(F.col("per_capita"))
    labels = [label for label, _ in P.PRICE_BANDS]
    wide = groups.withColumn("band", band).groupBy(*by).agg(
        F.count("band").alias("n_all"), *[F.count_if(F.col("band") == b).alias(f"n{i}") for i, b in enumerate(labels)]
    )
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"n{i}").alias("n_groups")) for i, b in enumerate(labels)])
    return wide.select(*by, "n_all", F.inline(rows)).withColumn(
        "share", B.ratio(F.col("n_groups"), F.col("n_all"))
    ).drop("n_all")


def bucket_openers(groups: DataFrame, by: list[str]) -> DataFrame:
    """Openers of the two highest bands, one row each, most groups first."""
    top = [label for label, _ in P.PRICE_BANDS[:2]]
    counted = (
        groups.withColumn("bucket", B.price_band(F.col("per_capita")))
        .filter(F.col("bucket").isin(*top))
        .withColumn("opener", B.opener_label(F.col("opener")))
        .groupBy(*by, "bucket", "opener")
        .agg(F.count(F.lit(1)).alias("n_groups"))
    )
    # Ranks openers after the count, so a window holds the staff of a store.
    rank = F.row_number().over(W.partitionBy(*by, "bucket").orderBy(F.desc("n_groups"), "opener"))
    return counted.withColumn("position", rank).withColumn(
        "label", F.concat("opener", F.lit("("), F.col("n_groups").cast("string"), F.lit(")"))
    )


def opener_stats(groups: DataFrame, by: list[str], total: bool = True) -> DataFrame:
    named = groups.withColumn("opener", B.opener_label(F.col("opener")))
    sets = [[*by, "opener"], by] if total else [[*by, "opener"]]
    out = named.groupingSets(sets, *by, "opener").agg(
        F.when(F.grouping("opener") == 1, F.lit(P.TOTAL_ROW)).otherwise(F.col("opener")).alias("opener_name"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("revenue").alias("revenue"),
    )
    return out.drop("opener")


def visitor_stats(visits: DataFrame, by: list[str]) -> DataFrame:
    out = visits.groupingSets([[*by, "waiter"], by], *by, "waiter").agg(
        F.when(F.grouping("waiter") == 1, F.lit(P.TOTAL_ROW)).otherwise(F.col("waiter")).alias("waiter_name"),
        F.count(F.lit(1)).alias("n_visits"),
    )
    return out.drop("waiter")


def _listed_dish(dishes: dict[str, list[str]]) -> Column:
    """The listed dish a name belongs to, null for other names. The list is configuration."""
    cases = [(name, dish) for dish, names in dishes.items() for name in [dish, *names]]
    return reduce(lambda acc, nd: acc.when(F.col("name") == nd[0], F.lit(nd[1])), cases[1:],
                  F.when(F.col("name") == cases[0][0], F.lit(cases[0][1])))


def dish_sales(sold: DataFrame, dishes: dict[str, list[str]], by: list[str] = ()) -> DataFrame:
    """Portions of listed dishes, aliases merged. `sold` holds lines that count for sales."""
    return (
        sold.withColumn("dish", _listed_dish(dishes))
        .filter("dish is not null")
        .groupBy(*by, "dish")
        .agg(F.sum("qty").alias("qty"))
    )


def daypart_top(sold: DataFrame, by: list[str], n: int = 6) -> DataFrame:
    """Best selling dishes per daypart; ranks run over the menu, not over lines."""
    qty = sold.groupBy(*by, "daypart", "name").agg(F.sum("qty").alias("qty"))
    rank = F.row_number().over(W.partitionBy(*by, "daypart").orderBy(F.desc("qty"), "name"))
    return qty.withColumn("position", rank).filter(F.col("position") <= n)


def order_index(groups: DataFrame) -> DataFrame:
    """All groups by table, date and time."""
    cols = [
        "store", "table_name", "biz_date", "first_time", "last_time", "last_checkout", "group_id", "n_orders",
        "item_count", "guests", "amount", "revenue", "per_capita", "member", "opener", "red_line",
    ]
    return red_line(groups).select(*cols).orderBy("table_name", "biz_date", "first_time", "group_id")


def group_orders(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """Paid orders of the given groups, with the group's facts. The link from group to orders.

    A long table rather than a list of order numbers per group: a group may hold any number.
    """
    facts = groups.select("group_id", F.col("daypart").alias("group_daypart"), F.col("guests").alias("group_guests"))
    paid = merged.filter(F.col("revenue") > 0)
    return paid.select("order_no", "store", "biz_date", "order_time", "revenue", "group_id", "decision").join(facts, "group_id")


def group_detail(groups: DataFrame, links: DataFrame, items: DataFrame, linked_visits: DataFrame) -> DataFrame:
    """Sub-orders, items with revenue and visits of each group, one row per part.

    Rows instead of nested lists, so no group has to fit into one row.
    """
    none_m, none_s = F.lit(None).cast("decimal(18,2)"), F.lit(None).cast("string")
    inside = links.join(groups.select("group_id"), "group_id", "left_semi")
    orders = inside.select(
        "group_id", F.lit("order").alias("part"), "order_no", F.col("decision").alias("name"), none_m.alias("qty"),
        F.col("revenue").cast("decimal(18,2)").alias("value"),
    )
    lines = (
        items.filter(F.col("item_revenue") > 0)
        .join(inside.select("order_no", "group_id"), "order_no")
        .select(
            "group_id", F.lit("item").alias("part"), "order_no", "name", F.col("qty").cast("decimal(18,2)").alias("qty"),
            F.col("item_revenue").alias("value"),
        )
    )
    visits = linked_visits.join(groups.select("group_id"), "group_id", "left_semi").select(
        "group_id",
        F.when(F.col("amount_matched"), "visit_by_match").otherwise("visit").alias("part"),
        "order_no",
        F.coalesce("transcript", none_s).alias("name"),
        none_m.alias("qty"),
        F.col("satisfaction").cast("decimal(18,2)").alias("value"),
    )
    return orders.unionByName(lines).unionByName(visits)


def top_bottom_groups(groups: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The n highest and lowest per-capita groups. A rank filter is cut to n per task before the shuffle."""

    def first(order, end):
        w = W.partitionBy(*by).orderBy(order, "group_id")
        return groups.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).withColumn("which", F.lit(end))

    return first(F.desc("per_capita"), "highest").unionByName(first(F.asc("per_capita"), "lowest"))


def per_capita_rank(groups: DataFrame, by: list[str]) -> DataFrame:
    """Rank of every group by per-capita, highest first, ties share a rank.

    Ranks are sums of counts of distinct values: whole yuan first, then the at most 100 values
    within one yuan. No window ever holds groups, so a large store or day is no hot task.
    """
    values = groups.groupBy(*by, "per_capita").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "yuan", F.floor("per_capita").cast("bigint")
    )
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = values.groupBy(*by, "yuan").agg(F.sum("n").alias("n"))
    steps = steps.select(*by, "yuan", before(W.partitionBy(*by).orderBy(F.desc("yuan")), "n").alias("above"))
    inner = values.withColumn("inner", before(W.partitionBy(*by, "yuan").orderBy(F.desc("per_capita")), "n"))
    ranks = inner.join(steps, [*by, "yuan"]).select(
        *by, "per_capita", (F.col("above") + F.col("inner") + 1).cast("bigint").alias("per_capita_rank")
    )
    return groups.join(ranks, [*by, "per_capita"])
