"""Comparison of a week or month with the previous one and with the year before.

All three periods are read in one pass: rows carry the period they fall into and every value
is a conditional sum, so history is scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.operators.reports import ALL, _listed_dish

ROLES = ("current", "previous", "last_year")


@dataclass(frozen=True)
class Period:
    """A full week (Monday to Sunday) or month and its two comparison periods."""

    mode: str
    start: date

    def __post_init__(self):
        if self.mode not in ("week", "month"):
            raise ValueError("mode is 'week' or 'month'")
        if self.mode == "week" and self.start.weekday() != 0:
            raise ValueError("a week starts on a Monday")
        if self.mode == "month" and self.start.day != 1:
            raise ValueError("a month starts on its first day")

    @property
    def bounds(self) -> dict[str, tuple[date, date]]:
        s = self.start
        if self.mode == "week":
            starts = (s, s - timedelta(days=7), s - timedelta(days=364))
            return {r: (x, x + timedelta(days=6)) for r, x in zip(ROLES, starts)}
        before = (s - timedelta(days=1)).replace(day=1)
        starts = (s, before, s.replace(year=s.year - 1))
        return {r: (x, (x + timedelta(days=31)).replace(day=1) - timedelta(days=1)) for r, x in zip(ROLES, starts)}


def period_role(day: Column, period: Period) -> Column:
    """current, previous or last_year; null outside all three, so a filter on it prunes the scan."""
    out = F.lit(None).cast("string")
    for role, (a, b) in period.bounds.items():
        out = F.when(day.between(F.lit(a), F.lit(b)), F.lit(role)).otherwise(out)
    return out


def in_period(df: DataFrame, day: str, period: Period) -> DataFrame:
    """Rows of the three periods with their role; the date bounds reach the scan as filters."""
    cond = F.lit(False)
    for a, b in period.bounds.values():
        cond = cond | F.col(day).between(F.lit(a), F.lit(b))
    return df.filter(cond).withColumn("role", period_role(F.col(day), period))


def orders_in_periods(orders: DataFrame, period: Period, cutover_hour: int = 0) -> DataFrame:
    """Orders of the business days of the three periods.

    Sessions never cross a business day, so the merge may run on these orders alone. The
    bounds are plain comparisons on the order time, which reach the scan.
    """
    cond = F.lit(False)
    for a, b in period.bounds.values():
        start = datetime.combine(a, time(cutover_hour))
        end = datetime.combine(b, time(cutover_hour)) + timedelta(days=1)
        lo, hi = (F.lit(x.isoformat(" ")).cast("timestamp_ntz") for x in (start, end))
        cond = cond | ((F.col("order_time") >= lo) & (F.col("order_time") < hi))
    return orders.filter(cond)


def period_bounds(days: DataFrame, mode: str) -> DataFrame:
    """The three periods of every week or month that has a day in `days` (order_date)."""
    unit = "week" if mode == "week" else "month"
    cur = days.select(F.date_trunc(unit, F.col("order_date").cast("timestamp_ntz")).cast("date").alias("s")).distinct()
    s = F.col("s")
    if mode == "week":
        starts = [s, F.date_add(s, -7), F.date_add(s, -364)]
        end = lambda x: F.date_add(x, 6)
    else:
        starts = [s, F.add_months(s, -1), F.add_months(s, -12)]
        end = F.last_day
    rows = F.array(*[F.struct(F.lit(r).alias("role"), x.alias("start"), end(x).alias("end")) for r, x in zip(ROLES, starts)])
    return cur.select(s.alias("period"), F.inline(rows))


def period_validate(orders: DataFrame, mode: str) -> DataFrame:
    """Per store and period: is it a full week or month with orders on every day?"""
    unit = "week" if mode == "week" else "month"
    day = F.col("order_time").cast("date")
    days = orders.select("store", day.alias("day")).distinct()
    start = F.date_trunc(unit, F.col("day").cast("timestamp_ntz")).cast("date")
    out = days.groupBy("store", start.alias("period_start")).agg(F.count(F.lit(1)).alias("n_days"))
    end = F.date_add("period_start", 6) if mode == "week" else F.last_day("period_start")
    out = out.withColumn("period_end", end)
    return out.withColumn("complete", F.col("n_days") == F.datediff("period_end", "period_start") + 1)


def _sums(measures: dict[str, Column]) -> list[Column]:
    return [
        F.sum(F.when(F.col("role") == r, m)).alias(f"{name}_{r}") for name, m in measures.items() for r in ROLES
    ]


def _deltas() -> dict[str, Column]:
    """Change and rate of change of the current value against both other periods."""
    cur = F.col("current")
    out = {}
    for r in ("previous", "last_year"):
        out[f"delta_{r}"] = cur - F.col(r)
        out[f"rate_{r}"] = F.try_divide(cur - F.col(r), F.nullif(F.col(r), F.lit(0.0)))
    return out


def period_compare(groups: DataFrame, period: Period, by: list[str]) -> DataFrame:
    """Revenue, guests and per-capita of the three periods: total, area, daypart, daypart by area."""
    g = in_period(groups, "biz_date", period)
    sets = [by, [*by, "area"], [*by, "daypart"], [*by, "daypart", "area"]]
    wide = g.groupingSets(sets, *by, "daypart", "area").agg(
        *[F.when(F.grouping(c) == 1, F.lit(ALL)).otherwise(F.col(c)).alias(f"{c}_l") for c in ("daypart", "area")],
        *_sums({"revenue": F.col("revenue"), "guests": F.col("guests")}),
    ).drop("daypart", "area").withColumnsRenamed({"daypart_l": "daypart", "area_l": "area"})

    def metric(name, of):
        return F.struct(F.lit(name).alias("metric"), *[of(r).cast("double").alias(r) for r in ROLES])

    zero = F.lit(0.0)
    rows = F.array(
        metric("revenue", lambda r: F.coalesce(F.col(f"revenue_{r}").cast("double"), zero)),
        metric("guests", lambda r: F.coalesce(F.col(f"guests_{r}").cast("double"), zero)),
        metric("per_capita", lambda r: B.ratio(F.col(f"revenue_{r}"), F.col(f"guests_{r}"))),
    )
    return wide.select(*by, "daypart", "area", F.inline(rows)).withColumns(_deltas())


def whole_revenue(pos_orders: DataFrame, takeaway_done: DataFrame, period: Period, by: list[str]) -> DataFrame:
    """Total rows of the period report that close with the back office, in the columns of `period_compare`.

    Whole revenue is that of all paid dine-in orders, groups the report filters out included, and of
    completed takeaway orders. Both sides carry the day as `biz_date`.
    """
    cols = [*by, "biz_date", "revenue"]
    both = pos_orders.select(*cols, F.lit(True).alias("pos")).unionByName(takeaway_done.select(*cols, F.lit(False).alias("pos")))
    r = F.col("revenue")
    parts = {"pos_revenue": F.when(F.col("pos"), r), "takeaway_revenue": F.when(~F.col("pos"), r), "whole_revenue": r}
    wide = in_period(both, "biz_date", period).groupBy(*by).agg(*_sums(parts))
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.coalesce(F.col(f"{m}_{x}").cast("double"), F.lit(0.0)).alias(x) for x in ROLES]) for m in parts
    ])
    return wide.select(*by, F.lit(ALL).alias("daypart"), F.lit(ALL).alias("area"), F.inline(rows)).withColumns(_deltas())


def _compare(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row per key with the sum of value in each period."""
    wide = df.groupBy(*keys).agg(*_sums({"v": value}))
    cols = [F.coalesce(F.col(f"v_{r}").cast("double"), F.lit(0.0)).alias(r) for r in ROLES]
    return wide.select(*keys, *cols).withColumns(_deltas())


def dish_compare(sold: DataFrame, dishes: dict[str, list[str]], period: Period, by: list[str]) -> DataFrame:
    """Portions of listed dishes in the three periods. `sold` carries the day of its order."""
    listed = in_period(sold, "biz_date", period).withColumn("dish", _listed_dish(dishes)).filter("dish is not null")
    return _compare(listed, [*by, "dish"], F.col("qty"))


def drink_ranking(sold: DataFrame, by: list[str]) -> DataFrame:
    """Drinks and desserts by portions; sizes of one name are one entry."""
    drinks = sold.filter(B.is_drink(F.col("category")))
    return drinks.groupBy(*by, B.core_name(F.col("name")).alias("core_name"), "category").agg(F.sum("qty").alias("qty"))


def category_distribution(sold: DataFrame, period: Period, by: list[str]) -> DataFrame:
    """Revenue by category with a total row, its share and the changes.

    `sold` holds the counted lines of all paid dine-in orders, so that the total closes with their revenue.
    """
    s = in_period(sold, "biz_date", period)
    wide = s.groupingSets([[*by, "category"], by], *by, "category").agg(
        F.when(F.grouping("category") == 1, F.lit(P.TOTAL_ROW)).otherwise(F.col("category")).alias("category_l"),
        *_sums({"v": F.col("item_revenue")}),
    )
    cols = [F.coalesce(F.col(f"v_{r}").cast("double"), F.lit(0.0)).alias(r) for r in ROLES]
    rows = wide.select(*by, F.col("category_l").alias("category"), *cols)
    # A window over the categories of one report.
    total = F.max(F.when(F.col("category") == P.TOTAL_ROW, F.col("current"))).over(W.partitionBy(*by))
    return rows.withColumn("share", F.try_divide("current", F.nullif(total, F.lit(0.0)))).withColumns(_deltas())


def bucket_compare(groups: DataFrame, period: Period, by: list[str]) -> DataFrame:
    """Groups per price band in the three periods, every band present."""
    g = in_period(groups, "biz_date", period).withColumn("band", B.price_band(F.col("per_capita")))
    labels = [label for label, _ in P.PRICE_BANDS]

    def n(band, role):
        return F.count_if((F.col("band") == band) & (F.col("role") == role)).cast("double")

    wide = g.groupBy(*by).agg(
        *[n(b, r).alias(f"n{i}_{r}") for i, b in enumerate(labels) for r in ROLES],
        F.count_if(F.col("role") == "current").cast("double").alias("n_current"),
    )
    rows = F.array(*[
        F.struct(F.lit(b).alias("bucket"), *[F.col(f"n{i}_{r}").alias(r) for r in ROLES]) for i, b in enumerate(labels)
    ])
    out = wide.select(*by, "n_current", F.inline(rows))
    return out.withColumn("share", F.try_divide("current", F.nullif("n_current", F.lit(0.0)))).drop("n_current").withColumns(_deltas())


def revenue_closure(totals: DataFrame, categories: DataFrame, back_office: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Do the reported tables agree? One row per check and store.

    The back office's revenue of the current period against `whole_revenue`, and the total row of
    `category_distribution` against the POS revenue reported there. `totals` and `categories` are those two
    reports by store, `back_office` is (store, revenue).
    """

    def of(metric):
        return F.max(F.when(F.col("metric") == metric, F.col("current")))

    reported = totals.groupBy("store").agg(of("whole_revenue").alias("whole"), of("pos_revenue").alias("pos"))
    cats = categories.filter(F.col("category") == P.TOTAL_ROW).select("store", F.col("current").alias("categories"))
    back = back_office.groupBy("store").agg(F.sum("revenue").alias("total"))
    all_ = back.join(reported, "store", "full").join(cats, "store", "full")
    x = lambda c: F.coalesce(F.col(c).cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))

    def check(name, left, right):
        return F.struct(F.lit(name).alias("check"), left.cast("double").alias("left_value"), right.cast("double").alias("right_value"),
                        (left - right).cast("double").alias("diff"))

    rows = F.array(check("total_is_pos_and_takeaway", x("total"), x("whole")), check("categories_are_pos", x("categories"), x("pos")))
    return all_.select("store", F.inline(rows)).withColumn("closes", F.abs("diff") < tolerance)


def completeness_notes(orders: DataFrame, period: Period, stores: DataFrame) -> DataFrame:
    """Days without orders in each comparison period, per store."""
    bounds = F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end")) for r, (a, b) in period.bounds.items()
    ])
    want = stores.select("store").distinct().select("store", F.inline(bounds)).withColumn(
        "day", F.explode(F.sequence("start", "end"))
    )
    have = in_period(orders.select("store", F.col("order_time").cast("date").alias("day")), "day", period)
    missing = want.join(have.select("store", "day").distinct(), ["store", "day"], "left_anti")
    return missing.groupBy("store", "role").agg(
        F.count(F.lit(1)).alias("n_missing"), F.min("day").alias("first_missing"), F.max("day").alias("last_missing")
    )
