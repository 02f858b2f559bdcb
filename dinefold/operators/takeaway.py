"""Takeaway orders: cleaning, masking, status and statistics. Independent of the merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.functions.cells import is_digit_id, real_text
from dinefold.operators import quantiles
from dinefold.operators.cleaning import drop_total_rows
from dinefold.sources.store import upsert_latest

KEY = ["store", "source", "takeaway_id"]
# Columns that may leave this module; anything else, personal data first of all, is dropped.
PUBLIC_COLUMNS = (
    "store", "source", "serial_no", "takeaway_id", "cashier_order_no", "order_time", "business_date", "accept_time",
    "delivered_time", "first_settle_time", "status", "delivery_status", "delivery_method", "order_amount", "items_amount",
    "surcharge", "item_discount", "item_revenue", "box_fee", "packing_fee", "delivery_fee", "order_discount",
    "platform_discount", "paid", "expense", "commission", "delivery_expense", "other_expense", "partial_refund", "revenue",
)


def takeaway_mask(df: DataFrame) -> DataFrame:
    """Only the allowed columns."""
    return df.select(*[c for c in PUBLIC_COLUMNS if c in df.columns])


def with_store(df: DataFrame, store: str | None = None) -> DataFrame:
    """Store: given by the caller, else named in the file, else in the file name."""
    named = (
        F.when(F.col("file").contains("万荷"), P.STORE_A)
        .when(F.col("file").contains("保利"), P.STORE_B)
        .when(F.col("file").contains("湾里"), P.STORE_C)
        if "file" in df.columns
        else F.lit(None).cast("string")
    )
    inside = B.normalize_store(real_text(F.col("store")))
    inside = F.when(inside != P.STORE_UNKNOWN, inside)
    return df.withColumn("store", F.coalesce(F.lit(store).cast("string"), inside, named, F.lit(P.STORE_UNKNOWN)))


def takeaway_clean(df: DataFrame, store: str | None = None) -> DataFrame:
    """Masked orders without total rows, one per (store, source, id), the latest wins."""
    seq = "seq" if "seq" in df.columns else "serial_no"
    df = drop_total_rows(with_store(df, store), seq, "takeaway_id")
    df = takeaway_mask(df.filter(is_digit_id(F.col("takeaway_id"))))
    return upsert_latest(df, KEY, ["order_time", "serial_no"])


def takeaway_status(df: DataFrame) -> DataFrame:
    """valid: completed; returned: any other status. Rows without a digit id have none."""
    kind = F.when(F.col("status").eqNullSafe(P.TAKEAWAY_DONE), "valid").otherwise("returned")
    return df.withColumn("kind", F.when(is_digit_id(F.col("takeaway_id")), kind))


def valid_orders(df: DataFrame) -> DataFrame:
    return takeaway_status(df).filter(F.col("kind") == "valid")


def takeaway_overview(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Orders, returns, money and rates; money counts valid orders only."""
    valid = F.col("kind") == "valid"

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(valid, c)), F.lit(0).cast("decimal(18,2)"))

    discount = F.abs("item_discount") + F.abs("order_discount") + F.abs("platform_discount")
    out = takeaway_status(df).groupBy(*by).agg(
        F.count_if(valid).alias("n_orders"),
        F.count_if(F.col("kind") == "returned").alias("n_returned"),
        total(F.col("order_amount")).alias("order_amount"),
        total(F.col("revenue")).alias("revenue"),
        total(F.col("paid")).alias("paid"),
        total(F.col("commission")).alias("commission"),
        total(F.col("expense")).alias("expense"),
        total(discount).alias("discount"),
        total(F.col("partial_refund")).alias("partial_refund"),
    )
    return out.withColumns(
        {
            "average": B.ratio(F.col("revenue"), F.col("n_orders")),
            "commission_rate": B.ratio(F.abs("commission"), F.col("paid")),
            "expense_rate": B.ratio(F.abs("expense"), F.col("paid")),
        }
    )


def takeaway_hourly(df: DataFrame, by: list[str]) -> DataFrame:
    """Orders and revenue by hour of order, every hour present, and the subtotals of both dayparts."""
    valid = valid_orders(df)
    hour = F.hour("order_time")
    per_hour = valid.groupBy(*by, hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("revenue").alias("revenue")
    )
    # Every hour exists once per report; the sums are joined onto them after aggregation.
    hours = per_hour.select(*by).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    dense = hours.join(per_hour, [*by, "hour"], "left").select(
        *by,
        F.col("hour"),
        F.when(F.col("hour") < 16, P.LUNCH).otherwise(P.DINNER).alias("daypart"),
        F.coalesce("n_orders", F.lit(0).cast("bigint")).alias("n_orders"),
        F.coalesce("revenue", F.lit(0)).cast("decimal(28,2)").alias("revenue"),
    )
    return dense.groupingSets([[*by, "daypart", "hour"], [*by, "daypart"]], *by, "daypart", "hour").agg(
        F.when(F.grouping("hour") == 1, F.lit(-1)).otherwise(F.col("hour")).alias("order_hour"),
        F.sum("n_orders").alias("n_orders"),
        F.sum("revenue").alias("revenue"),
    ).drop("hour")


def takeaway_fulfilment(df: DataFrame, by: list[str]) -> DataFrame:
    """Minutes to accept and to deliver: means, median, 90 % mark, late orders.

    Median and mark are the exact values at their ranks, found by narrowing (see `quantiles`), so that no
    store is one task's state.
    """
    accept = B.micros(F.col("accept_time")) - B.micros(F.col("order_time"))
    to_door = B.micros(F.col("delivered_time")) - B.micros(F.col("order_time"))
    deliver = F.when(F.col("delivery_status") == P.DELIVERY_DONE, to_door)
    timed = valid_orders(df).select(*by, accept.alias("accept_us"), deliver.alias("deliver_us"))
    counted = timed.groupBy(*by, "deliver_us").agg(
        F.count(F.lit(1)).alias("n"), F.count("accept_us").alias("n_accept"), F.sum("accept_us").alias("accept_us")
    )
    n = F.when(F.col("deliver_us").isNotNull(), F.col("n"))
    minutes = lambda us: us / F.lit(float(B.MINUTE_US))
    late = F.col("deliver_us") > P.LATE_DELIVERY_MINUTES * B.MINUTE_US
    sums = counted.groupBy(*by).agg(
        minutes(B.ratio(F.sum("accept_us"), F.sum("n_accept"))).alias("mean_accept"),
        minutes(B.ratio(F.sum(F.col("deliver_us") * n), F.sum(n))).alias("mean_delivery"),
        F.coalesce(F.sum(F.when(late, n)), F.lit(0)).cast("bigint").alias("n_late"),
    )
    marks = quantiles.marks(counted.select(*by, F.col("deliver_us").alias("value"), "n"), by, {"p50": 0.5, "p90": 0.9})
    found = marks.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.round(minutes(F.col(m)), 4).alias(f"{m}_delivery") for m in ("p50", "p90")])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    return sums.join(found, same, "left").select(*by, "mean_accept", "mean_delivery", "p50_delivery", "p90_delivery", "n_late")


def takeaway_exceptions(df: DataFrame) -> DataFrame:
    """One row per order and reason."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("order_time", "accept_time", "delivered_time")])
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("status").eqNullSafe(P.TAKEAWAY_DONE), "returned"),
            F.when(F.col("delivery_status") == P.DELIVERY_WAITING, "awaiting_delivery"),
            F.when(F.col("partial_refund") != 0, "partial_refund"),
            F.when(F.col("order_amount") == 0, "zero_amount"),
            F.when(missing, "missing_times"),
        )
    )
    return df.select(*KEY, F.explode(reasons).alias("reason"))


def takeaway_detail(df: DataFrame) -> DataFrame:
    return takeaway_mask(valid_orders(df))
