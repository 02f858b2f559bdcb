"""Queries of sources and sinks. Written files go to the shared scratch folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.cleaning import LINE_COLS, NEWEST, REPEATED_SQL, repeated_lines
from dinefold.plans.out import plain
from dinefold.plans.prelude import oracle
from dinefold.session import scratch_dir
from dinefold.sources import store as S
from dinefold.sources.visits_csv import BOM, COLUMNS, read_visits


def visit_csv(spark, sf) -> str:
    """Write the visits as CSV files that begin with a byte order mark."""
    path = scratch_dir(spark, "visits")
    names = {name: header for header, (name, _) in COLUMNS.items()}
    v = R.visits(spark, sf)
    cols = [F.col(n).cast("string").alias((BOM if i == 0 else "") + names[n]) for i, n in enumerate(names)]
    v.select(*cols).write.csv(path, header=True, escape='"', quoteAll=True, nullValue="", emptyValue="")
    return path


@query(
    "csv_visits_scan",
    oracle(
        """select case when v.order_no = ' ' then null else v.order_no end as order_no, store, table_name, guests,
          cast(paid as double) as paid, strftime(order_time, '%Y-%m-%d %H:%M:%S') as order_time, waiter, member_status,
          transcript, satisfaction, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from v"""
    ),
)
def csv_visits_scan(spark, sf):
    out = read_visits(spark, visit_csv(spark, sf)).drop("source_file")
    return plain(out.withColumn("order_no", F.nullif(F.trim("order_no"), F.lit(""))))


def archive_files(spark, sf) -> str:
    """Line items written to files by ship year, as exports of different age."""
    path = scratch_dir(spark, "archives")
    lines = repeated_lines(spark, sf)
    lines.withColumn("year", F.year("loaded")).write.partitionBy("year").parquet(path)
    return path


DEDUP_ROWS = f"""
  select *, row_number() over (partition by order_no, sku, name, seq
    order by loaded desc, l_partkey desc, l_suppkey desc, line_amount desc, qty desc) as rn from ({REPEATED_SQL})"""


@query("multi_file_load", f"select order_no, seq, sku, name, qty, line_amount from ({DEDUP_ROWS}) where rn = 1")
def multi_file_load(spark, sf):
    out = S.multi_file_load(spark, [archive_files(spark, sf)], ["order_no", "sku", "name", "seq"], NEWEST)
    return plain(out.select(*LINE_COLS))


@query(
    "date_extent",
    oracle(
        """select store, strftime(min(order_time), '%Y-%m-%d %H:%M:%S') as period_start,
        strftime(max(order_time), '%Y-%m-%d %H:%M:%S') as period_end from o group by store"""
    ),
)
def date_extent(spark, sf):
    o = R.orders(spark, sf).groupBy("store")
    return plain(o.agg(F.min("order_time").alias("period_start"), F.max("order_time").alias("period_end")))


@query(
    "upsert_latest",
    f"""select order_no, sku, seq, qty, line_amount from (select *, row_number() over (partition by order_no, sku
      order by loaded desc, l_partkey desc, l_suppkey desc, line_amount desc, seq desc, name desc, qty desc) as rn
      from ({REPEATED_SQL})) where rn = 1""",
)
def upsert_latest(spark, sf):
    out = S.upsert_latest(repeated_lines(spark, sf), ["order_no", "sku"], NEWEST)
    return plain(out.select("order_no", "sku", "seq", "qty", "line_amount"))


@query(
    "archive_backfill",
    f"""select order_no, seq, sku, name, qty, line_amount from (select *, row_number() over (partition by order_no, sku, name, seq
      order by case when loaded < timestamp '1999-01-01' then 0 else 1 end desc, qty desc, line_amount desc) as rn
      from ({REPEATED_SQL})) where rn = 1""",
)
def archive_backfill(spark, sf):
    """An older and a newer archive; the newer line replaces the same key, others stay."""
    lines = repeated_lines(spark, sf)
    old = F.col("loaded") < F.lit("1999-01-01").cast("timestamp_ntz")
    out = S.merge_archives(
        lines.filter(old).select(*LINE_COLS), lines.filter(~old).select(*LINE_COLS), ["order_no", "sku", "name", "seq"]
    )
    return plain(out.select(*LINE_COLS))


@query(
    "mart_overwrite",
    oracle(
        """select store, strftime(cast(order_time as date), '%Y-%m-%d') as order_date, count(*) as n_orders,
        cast(sum(revenue) as double) as revenue from o group by all"""
    ),
)
def mart_overwrite(spark, sf):
    """Write the mart, rerun the second half of the month store by store, read back: what was run again is
    replaced, not doubled, and the other stores' days stay."""
    o = R.orders(spark, sf).withColumn("order_date", F.col("order_time").cast("date"))
    mart = o.groupBy("store", "order_date").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("revenue").alias("revenue"))
    path = scratch_dir(spark, "mart")
    wrong = F.col("order_date") >= F.lit("2024-01-16").cast("date")
    first = mart.withColumn("n_orders", F.when(wrong, F.col("n_orders") + 1).otherwise(F.col("n_orders")))
    S.mart_overwrite(first, path, ["order_date", "store"])
    of_a = F.col("store") == P.STORE_A
    for part in (of_a, ~of_a):
        S.mart_overwrite(mart.filter(wrong & part), path, ["order_date", "store"])
    return plain(spark.read.parquet(path).select("store", "order_date", "n_orders", "revenue"))


ROW = "order_no string, store string, order_time timestamp_ntz, revenue decimal(18,2), guests int, remark string, checkout_time timestamp_ntz"


@query(
    "row_json_roundtrip",
    oracle(
        """select order_no, store, strftime(order_time, '%Y-%m-%d %H:%M:%S') as order_time, cast(revenue as double) as revenue,
        guests, remark, strftime(checkout_time, '%Y-%m-%d %H:%M:%S') as checkout_time from o"""
    ),
)
def row_json_roundtrip(spark, sf):
    cols = [c.split()[0] for c in ROW.split(", ")]
    stored = S.rows_to_json(R.orders(spark, sf).select(*cols), ["order_no"])
    return plain(S.rows_from_json(stored, ROW))


@query(
    "incremental_new_keys",
    oracle("select order_no, store from o where order_no not in (select cast(l_orderkey as varchar) from lineitem)"),
)
def incremental_new_keys(spark, sf):
    """Orders the store of item lines does not know yet."""
    stored = R.items(spark, sf).select("order_no")
    return S.incremental_new_keys(R.orders(spark, sf).select("order_no", "store"), stored, ["order_no"])
