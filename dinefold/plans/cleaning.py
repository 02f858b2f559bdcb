"""Queries of cleaning, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.operators import cleaning as C
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.merge import groups
from dinefold.plans.out import plain
from dinefold.plans.prelude import oracle


@query("clean_orders", oracle("select order_no, store, table_name from clean_o"))
def clean_orders(spark, sf):
    return C.clean_orders(R.orders(spark, sf)).select("order_no", "store", "table_name")


COUNTS = """count(*) as raw_orders, count(*) filter (where contains(table_name, '外点自取')) as takeaway_orders,
  count(*) filter (where order_type <> '堂食' and not contains(table_name, '外点自取')) as not_dine_in_orders"""


@query("raw_counts", oracle(f"select store, {COUNTS} from o group by store"))
def raw_counts(spark, sf):
    return C.raw_counts(R.orders(spark, sf))


@query(
    "pre_merge_counts",
    oracle(
        f"""select store, strftime(d, '%Y-%m-%d') as order_date, {COUNTS} from (select *, cast(order_time as date) as d from o)
        group by grouping sets ((store, d), (d))"""
    ),
)
def pre_merge_counts(spark, sf):
    return plain(C.pre_merge_counts(R.orders(spark, sf)))


def text_items(spark, sf):
    """Line items as an export would hold them: text, some broken numbers, some total rows."""
    li = R.table(spark, sf, "lineitem")
    total = (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0.08)
    return li.select(
        F.when(F.col("l_tax") == 0.07, "-").otherwise(F.col("l_orderkey").cast("string")).alias("order_no"),
        F.when(total, P.TOTAL_ROW).otherwise(F.col("l_linenumber").cast("string")).alias("seq"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku"),
        F.when(F.col("l_tax") == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("line_amount"),
    )


CLEAN_ITEMS_SQL = """
  select cast(l_orderkey as varchar) as order_no, l_linenumber as seq, 'SKU' || cast(l_partkey as varchar) as sku,
    case when l_tax <> 0 then l_quantity end as qty, cast(cast(l_extendedprice as decimal(18,2)) as double) as line_amount
  from lineitem where l_tax <> 0.07 and not (l_linenumber = 7 and l_tax = 0.08)"""


@query("clean_items", CLEAN_ITEMS_SQL)
def clean_items(spark, sf):
    return plain(C.clean_items(text_items(spark, sf)))


@query(
    "drop_total_rows",
    """select l_linenumber as line, count(*) as n from lineitem
    where l_tax <> 0.07 and not (l_linenumber = 7 and l_tax = 0.08) group by l_linenumber""",
)
def drop_total_rows(spark, sf):
    kept = C.drop_total_rows(text_items(spark, sf), "seq", "order_no")
    return kept.groupBy(F.col("seq").cast("int").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def repeated_lines(spark, sf):
    """Line items with few SKUs, so that keys repeat; the ship date is the load time."""
    li = R.table(spark, sf, "lineitem")
    sku = (F.col("l_partkey") % 5).cast("string")
    return li.select(
        F.col("l_orderkey").cast("string").alias("order_no"),
        F.col("l_linenumber").alias("seq"),
        F.concat(F.lit("SKU"), sku).alias("sku"),
        F.concat(F.lit("dish"), sku).alias("name"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("loaded"),
        "l_partkey",
        "l_suppkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("line_amount"),
    )


NEWEST = ["loaded", "l_partkey", "l_suppkey", "line_amount"]
REPEATED_SQL = """
  select cast(l_orderkey as varchar) as order_no, l_linenumber as seq, 'SKU' || cast(l_partkey % 5 as varchar) as sku,
    'dish' || cast(l_partkey % 5 as varchar) as name, l_quantity as qty, l_shipdate as loaded, l_partkey, l_suppkey,
    l_extendedprice as line_amount from lineitem"""
DEDUP_SQL = f"""
  select order_no, seq, sku, name, qty, line_amount from (select *, row_number() over (
    partition by order_no, seq, sku, name order by loaded desc, l_partkey desc, l_suppkey desc, line_amount desc, qty desc) as rn
    from ({REPEATED_SQL})) where rn = 1"""
LINE_COLS = ["order_no", "seq", "sku", "name", "qty", "line_amount"]


@query("item_line_dedup", DEDUP_SQL)
def item_line_dedup(spark, sf):
    return plain(C.item_line_dedup(repeated_lines(spark, sf), NEWEST).select(*LINE_COLS))


SALES = "count(*) as n_lines, cast(sum(qty) as double) as qty, cast(sum(item_revenue) as double) as item_revenue"


def by_category(items):
    return plain(
        items.groupBy("category").agg(
            F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("qty"), F.sum("item_revenue").alias("item_revenue")
        )
    )


@query("positive_revenue_items", oracle(f"select category, {SALES} from i where item_revenue > 0 group by category"))
def positive_revenue_items(spark, sf):
    return by_category(C.positive_revenue_items(R.items(spark, sf)))


@query(
    "package_parent_exclusion",
    oracle(f"select category, {SALES} from i where sale_type is distinct from '套餐' group by category"),
)
def package_parent_exclusion(spark, sf):
    return by_category(C.package_parent_exclusion(R.items(spark, sf)))


@query(
    "area_class",
    oracle(
        """select store, case when contains(table_name, '包间') and store <> '保利店' then '包间'
          when contains(table_name, '大厅') and store <> '保利店' then '大厅'
          when contains(table_name, '包房') and store = '保利店' then '包房'
          when contains(table_name, '沙发') and store = '保利店' then '沙发'
          when contains(table_name, '户外') then '户外' else '其他' end as area, count(*) as n_orders
        from o group by all"""
    ),
)
def area_class(spark, sf):
    return C.with_area(R.orders(spark, sf)).groupBy("store", "area").agg(F.count(F.lit(1)).alias("n_orders"))


@query(
    "daypart",
    oracle(
        """select store, case when hour(order_time) < 16 then '午市' else '晚市' end as daypart, count(*) as n_orders
        from o group by all"""
    ),
)
def daypart(spark, sf):
    return C.with_daypart(R.orders(spark, sf)).groupBy("store", "daypart").agg(F.count(F.lit(1)).alias("n_orders"))


@query("member_flag", oracle("select group_id, member from g"))
def member_flag(spark, sf):
    return groups(spark, sf).select("group_id", "member")


@query(
    "infer_store",
    oracle(
        """select file, store, n as n_common from (
          select file, o.store, count(distinct v.order_no) as n,
            row_number() over (partition by file order by count(distinct v.order_no) desc, o.store desc) as rn
          from (select order_no, strftime(created_at, '%Y-%m-%d') || waiter as file from v) v join o using (order_no)
          group by file, o.store) where rn = 1"""
    ),
)
def infer_store(spark, sf):
    """Visit files here: one per day and waiter."""
    v = R.visits(spark, sf)
    v = v.select("order_no", F.concat(F.date_format("created_at", "yyyy-MM-dd"), "waiter").alias("file"))
    return C.infer_store(v, R.orders(spark, sf), "file")


@query(
    "split_visits",
    oracle(
        """select visit_id, case when v.order_no is null or trim(v.order_no) = '' then 'no_order_no'
          when o.order_no is null then 'unknown_order_no' else 'usable' end as visit_kind
        from v left join o on o.order_no = v.order_no"""
    ),
)
def split_visits(spark, sf):
    return C.split_visits(R.visits(spark, sf), R.orders(spark, sf)).select("visit_id", "visit_kind")


@query(
    "corpus_projection",
    oracle(
        """select order_no, guests, store, waiter, transcript, satisfaction,
          strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from v where trim(transcript) <> ''"""
    ),
)
def corpus_projection(spark, sf):
    return plain(C.corpus_projection(R.visits(spark, sf)))
