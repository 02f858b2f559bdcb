"""Cleaning, projections and predicates on orders, items and visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.functions.cells import is_digit_id, real_text
from dinefold.sources.store import upsert_latest

MONEY = "decimal(18,2)"


def drop_total_rows(df: DataFrame, seq: str, id_col: str) -> DataFrame:
    """Remove summary rows: sequence 'total' or a dash for an id."""
    is_total = (F.col(seq).cast("string") == P.TOTAL_ROW) | (F.col(id_col) == P.DASH)
    return df.filter(~F.coalesce(is_total, F.lit(False)))


def is_pickup():
    return F.coalesce(F.col("table_name").contains(P.PICKUP_TABLE), F.lit(False))


def is_dine_in():
    return F.coalesce(F.col("order_type") == P.DINE_IN, F.lit(False))


def clean_orders(orders: DataFrame) -> DataFrame:
    """Dine-in orders with a digit id, without pickup tables."""
    return orders.filter(is_digit_id(F.col("order_no")) & is_dine_in() & ~is_pickup())


def clean_items(items: DataFrame) -> DataFrame:
    """Drop total rows and cast numbers; text that is no number becomes null."""
    out = drop_total_rows(items, "seq", "order_no").filter(is_digit_id(F.col("order_no")))
    for c in ("unit_price", "qty", "line_amount", "item_revenue"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast(MONEY))
    return out.withColumn("seq", F.col("seq").try_cast("int"))


def pre_merge_flags(orders: DataFrame) -> DataFrame:
    return orders.select(
        "store",
        F.col("order_time").cast("date").alias("order_date"),
        is_pickup().alias("pickup"),
        (~is_dine_in() & ~is_pickup()).alias("not_dine_in"),
    )


def _counts():
    return [
        F.count(F.lit(1)).alias("raw_orders"),
        F.count_if("pickup").alias("takeaway_orders"),
        F.count_if("not_dine_in").alias("not_dine_in_orders"),
    ]


def raw_counts(orders: DataFrame) -> DataFrame:
    """Counts before cleaning, per store."""
    return pre_merge_flags(orders).groupBy("store").agg(*_counts())


def pre_merge_counts(orders: DataFrame) -> DataFrame:
    """Counts before cleaning per store and day; store is null in the rows of all stores."""
    flags = pre_merge_flags(orders)
    return flags.groupingSets(
        [["store", "order_date"], ["order_date"]], "store", "order_date"
    ).agg(*_counts())


def item_line_dedup(items: DataFrame, newest: list[str]) -> DataFrame:
    """One row per (order, sku, name, line seq): the newest load wins."""
    return upsert_latest(items, ["order_no", "sku", "name", "seq"], newest)


def positive_revenue_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("item_revenue") > 0)


def package_parent_exclusion(items: DataFrame) -> DataFrame:
    """Drop package parents; items without a sale type stay."""
    if "sale_type" not in items.columns:
        return items
    return items.filter(~F.col("sale_type").eqNullSafe(P.PACKAGE_PARENT))


def sold_items(items: DataFrame) -> DataFrame:
    """Lines that count for sales: revenue above zero, no package parents."""
    return package_parent_exclusion(positive_revenue_items(items))


def with_area(orders: DataFrame) -> DataFrame:
    return orders.withColumn("area", B.area_class(F.col("store"), F.col("table_name")))


def with_daypart(orders: DataFrame, time_col: str = "order_time") -> DataFrame:
    return orders.withColumn("daypart", B.daypart(F.col(time_col)))


def infer_store(visits: DataFrame, orders: DataFrame, by: str, explicit: str | None = None) -> DataFrame:
    """Per visit file the store that has most of its order numbers."""
    files = visits.select(by).distinct()
    if explicit is not None:
        return files.withColumn("store", F.lit(explicit))
    votes = (
        visits.select(by, "order_no")
        .join(orders.select("order_no", "store"), "order_no")
        .groupBy(by, "store")
        .agg(F.countDistinct("order_no").alias("n"))
    )
    # Ties go to the store name that sorts last.
    best = votes.groupBy(by).agg(F.max(F.struct("n", "store")).alias("m"))
    return best.select(by, F.col("m.store").alias("store"), F.col("m.n").alias("n_common"))


def split_visits(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Mark every visit as usable, without order number, or with an unknown one."""
    known = orders.select("order_no").distinct().withColumn("known", F.lit(True))
    v = visits.withColumn("order_no", real_text(F.col("order_no")))
    return (
        v.join(known, "order_no", "left")
        .withColumn(
            "visit_kind",
            F.when(F.col("known"), F.lit("usable"))
            .when(F.col("order_no").isNull(), F.lit("no_order_no"))
            .otherwise(F.lit("unknown_order_no")),
        )
        .drop("known")
    )


def corpus_projection(visits: DataFrame) -> DataFrame:
    """Visits with a transcript, in the columns of the corpus."""
    return visits.filter(real_text(F.col("transcript")).isNotNull()).select(
        "order_no", "guests", "store", "waiter", "transcript", "satisfaction", "created_at"
    )
