"""Daily tables per store; `sources.store.mart_overwrite` writes them so that reruns replace days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.operators import groups as G
from dinefold.operators import reports as R
from dinefold.sources import grid as GR

DAY = ["store", "biz_date"]


def daily_overview(groups: DataFrame) -> DataFrame:
    """Overview and member split as (store, day, category, sub_category)."""
    o = R.overview(groups, DAY)
    part, area = F.col("daypart"), F.col("area")
    category = (
        F.when((part == R.ALL) & (area == R.ALL), "total").when(part == R.ALL, "area").when(area == R.ALL, "daypart")
        .otherwise(F.concat(F.lit("daypart:"), part))
    )
    sub = F.when((part == R.ALL) & (area == R.ALL), F.lit(R.ALL)).when(area == R.ALL, part).otherwise(area)
    cols = [*DAY, "category", "sub_category", "n_groups", "revenue", "guests", "per_capita"]
    levels = o.withColumn("category", category).withColumn("sub_category", sub).select(*cols)
    members = (
        R.member_split(groups, DAY)
        .withColumn("category", F.lit("member"))
        .withColumn("sub_category", F.when(F.col("member"), "member").otherwise("non_member"))
    )
    return levels.unionByName(members.select(*cols))


def daily_order_counts(raw_orders: DataFrame, groups: DataFrame) -> DataFrame:
    return G.order_count_funnel(raw_orders, groups, ["store", "group_date"])


def daily_buckets(groups: DataFrame) -> DataFrame:
    return R.price_buckets(groups, DAY)


def daily_opener_stats(groups: DataFrame) -> DataFrame:
    return R.opener_stats(groups, DAY, total=False)


def items_for_period(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Items of every order of the groups of a period, not only of their first order.

    `lines` are those of the stored history, which carry day and group: a filter on folders, no join.
    """
    return lines.filter(F.col("biz_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("counted"))


def store_by_content(grid: DataFrame) -> DataFrame:
    """Store named inside a file; the file name only serves to warn."""
    meta = GR.sheet_metadata(grid)
    inside = B.normalize_store(F.coalesce("store_raw", F.lit("")))
    named = F.when(F.col("file").contains("万荷"), P.STORE_A).when(F.col("file").contains("保利"), P.STORE_B).when(
        F.col("file").contains("湾里"), P.STORE_C
    )
    return meta.select("file", inside.alias("store_name"), named.alias("name_in_file")).withColumn(
        "mismatch", F.coalesce(F.col("store_name") != F.col("name_in_file"), F.lit(False))
    )
