"""Drink statistics over the guests and groups of the merge.

Groups are counted by the set of drink categories they had: a group belongs to one store and day, so counts of sets add
up over days and stores, and a level (a category, a dimension, all drinks) is the sum of the sets that meet it. Eleven
categories make at most 2047 sets for each `by`, whatever the number of groups.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.operators.periods import ROLES, Period, in_period
from dinefold.operators.reports import ALL

SOFT, ALCOHOL = "非酒精", "含酒精"


def dimension(category: Column) -> Column:
    return F.when(category.isin(*P.DRINKS_SOFT), SOFT).when(category.isin(*P.DRINKS_ALCOHOL), ALCOHOL)


def drink_scope(items: DataFrame) -> DataFrame:
    """Lines of the eleven drink categories with their dimension."""
    return items.filter(B.is_drink(F.col("category"))).withColumn("dimension", dimension(F.col("category")))


def _totals(groups: DataFrame, pos: DataFrame, takeaway: DataFrame, by: list[str]) -> DataFrame:
    """Guests in scope and total revenue (order revenue plus completed takeaway), one row per `by`."""
    guests = groups.groupBy(*by).agg(F.sum("guests").cast("bigint").alias("guests"))
    revenue = (
        pos.select(*by, "revenue").unionByName(takeaway.select(*by, "revenue")).groupBy(*by).agg(
            F.sum("revenue").alias("total_revenue")
        )
    )
    return guests.join(revenue, by, "full")


#: The bit of each category in a set of categories.
BITS = {c: 1 << i for i, c in enumerate([*P.DRINKS_SOFT, *P.DRINKS_ALCOHOL])}
LEVELS = {SOFT: sum(BITS[c] for c in P.DRINKS_SOFT), ALCOHOL: sum(BITS[c] for c in P.DRINKS_ALCOHOL), ALL: sum(BITS.values())}


class Drinks(NamedTuple):
    """`sets` (by, categories, n_groups) and `sums` (by, dimension, category, qty, revenue); both add up over days."""

    sets: DataFrame
    sums: DataFrame


def drink_sets(sold: DataFrame, by: list[str]) -> DataFrame:
    """How many groups had each set of categories; lines without a group count for none."""
    bit = F.coalesce(*[F.when(F.col("category") == c, F.lit(b)) for c, b in BITS.items()])
    per = drink_scope(sold).filter("group_id is not null").groupBy(*by, "group_id").agg(F.bit_or(bit).alias("categories"))
    return per.groupBy(*by, "categories").agg(F.count(F.lit(1)).alias("n_groups"))


def drink_sums(sold: DataFrame, by: list[str]) -> DataFrame:
    return drink_scope(sold).groupBy(*by, "dimension", "category").agg(
        F.sum("qty").alias("qty"), F.sum("item_revenue").alias("revenue")
    )


def drinks_of(sold: DataFrame, by: list[str]) -> Drinks:
    return Drinks(drink_sets(sold, by), drink_sums(sold, by))


def _stats(drinks: Drinks, by: list[str], level: str, masks: dict[str, int]) -> DataFrame:
    """Groups, portions and revenue per `by` and `level`; its values are the keys of masks."""
    hit = lambda m: F.when(F.col("categories").bitwiseAND(F.lit(m)) != 0, F.col("n_groups")).otherwise(0)
    wide = drinks.sets.groupBy(*by).agg(*[F.sum(hit(m)).alias(f"n{i}") for i, m in enumerate(masks.values())])
    counts = wide.select(*by, F.inline(F.array(
        *[F.struct(F.lit(name).alias(level), F.col(f"n{i}").alias("n_groups")) for i, name in enumerate(masks)]
    )))
    sums = drinks.sums.groupBy(*by, level).agg(F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"))
    return sums.join(counts, [*by, level], "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


def _rates(df: DataFrame) -> DataFrame:
    """Attach rate: portions per guest. Share: of the total revenue."""
    return df.withColumn("attach_rate", B.ratio(F.col("qty"), F.col("guests"))).withColumn(
        "revenue_share", B.ratio(F.col("revenue"), F.col("total_revenue"))
    ).drop("guests", "total_revenue")


def category_stats(drinks: Drinks, totals: DataFrame, by: list[str]) -> DataFrame:
    stats = _stats(drinks, by, "category", BITS).withColumn("dimension", dimension(F.col("category")))
    return _rates(stats.join(totals, by))


def dimension_stats(drinks: Drinks, totals: DataFrame, by: list[str]) -> DataFrame:
    """Subtotals of both dimensions and of all drinks; a group with both counts in each and once in all."""
    # At most eleven rows for each `by` become two each.
    scope = F.explode(F.array(F.col("dimension"), F.lit(ALL))).alias("scope")
    levels = Drinks(drinks.sets, drinks.sums.select(*by, scope, "qty", "revenue"))
    return _rates(_stats(levels, by, "scope", LEVELS).join(totals, by))


def drink_category_stats(sold: DataFrame, groups: DataFrame, pos: DataFrame, takeaway: DataFrame, by: list[str]) -> DataFrame:
    return category_stats(drinks_of(sold, by), _totals(groups, pos, takeaway, by), by)


def drink_dimension_stats(sold: DataFrame, groups: DataFrame, pos: DataFrame, takeaway: DataFrame, by: list[str]) -> DataFrame:
    return dimension_stats(drinks_of(sold, by), _totals(groups, pos, takeaway, by), by)


def drink_compare(
    sold: DataFrame, groups: DataFrame, pos: DataFrame, takeaway: DataFrame, period: Period, by: list[str]
) -> DataFrame:
    daily = drinks_of(in_period(sold, "biz_date", period).drop("role"), [*by, "biz_date"])
    return drink_compare_daily(daily, groups, pos, takeaway, period, by)


def drink_compare_daily(
    daily: Drinks, groups: DataFrame, pos: DataFrame, takeaway: DataFrame, period: Period, by: list[str]
) -> DataFrame:
    """Three lines per category: this, previous and last year's period, each against this one.

    `daily` are the marts of each day, with `by` and `biz_date`. Every input is read once; its rows carry the
    period they fall into.
    """
    key = [*by, "role"]
    g = in_period(groups, "biz_date", period)
    p, t = in_period(pos, "biz_date", period), in_period(takeaway, "business_date", period)
    drinks = Drinks(*[in_period(x, "biz_date", period) for x in daily])
    stats = category_stats(drinks, _totals(g, p, t, key), key)
    wide = stats.groupBy(*by, "category").agg(
        *[F.max(F.when(F.col("role") == r, F.struct("n_groups", "qty", "revenue", "attach_rate", "revenue_share"))).alias(r) for r in ROLES]
    )

    def line(role):
        now = lambda c: F.col(f"current.{c}")
        return F.struct(
            F.lit(role).alias("role"),
            *[F.coalesce(F.col(f"{role}.{c}").cast("double"), F.lit(0.0)).alias(c) for c in ("n_groups", "qty", "revenue")],
            F.col(f"{role}.attach_rate").alias("attach_rate"),
            F.col(f"{role}.revenue_share").alias("revenue_share"),
            *[B.ratio(F.coalesce(F.col(f"{role}.{c}").cast("double"), F.lit(0.0)), now(c)).alias(f"{c}_to_current")
              for c in ("qty", "revenue")],
        )

    return wide.select(*by, "category", F.inline(F.array(*[line(r) for r in ROLES])))
