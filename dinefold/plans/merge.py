"""Queries of the merge, the groups and their filters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from dinefold.operators import cleaning as C
from dinefold.operators import groups as G
from dinefold.operators import sessions as S
from dinefold.params import MergeParams
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.out import plain
from dinefold.plans.prelude import fold_cte, oracle
from dinefold.session import stored


def clean(spark, sf):
    return C.clean_orders(R.orders(spark, sf))


def explain(spark, sf, p=MergeParams()):
    return S.explain_slots(clean(spark, sf), R.items(spark, sf), p)


def groups(spark, sf):
    return G.aggregate_groups(clean(spark, sf), R.items(spark, sf))


def merged_and_groups(spark, sf, orders=None, items=None):
    """Merged orders, written once, and the groups read off them; for queries that need both."""
    orders = clean(spark, sf) if orders is None else orders
    items = R.items(spark, sf) if items is None else items
    merged = stored(S.session_merge(orders, items, features=True), "merged")
    return merged, G.groups_from_merged(merged)


DAY = "strftime(biz_date, '%Y-%m-%d') as biz_date"


@query(
    "session_merge",
    oracle(f"select order_no, store, table_name, {DAY}, group_no as group_id, decision from fold"),
)
def session_merge(spark, sf):
    out = S.session_merge(clean(spark, sf), R.items(spark, sf))
    return plain(out.select("order_no", "store", "table_name", "biz_date", "group_id", "decision"))


OTHER = MergeParams(
    window_hours_regular=1,
    window_hours_private=2,
    concurrent_minutes=10,
    add_on_max_ratio=Decimal("0.80"),
    reopen_min_regular=20,
    small_ratio=Decimal("0.10"),
    small_line_cnt=1,
    score_threshold=50,
)


@query(
    "merge_params",
    oracle(
        f"select order_no, store, table_name, {DAY}, group_no as group_id, decision from fold_other",
        fold_other=fold_cte(OTHER).replace("from fold f", "from fold_other f"),
    ),
)
def merge_params(spark, sf):
    """The merge under other parameters than the defaults."""
    out = S.session_merge(clean(spark, sf), R.items(spark, sf), OTHER)
    return plain(out.select("order_no", "store", "table_name", "biz_date", "group_id", "decision"))


@query(
    "r0_concurrent",
    oracle(
        f"""select store, table_name, {DAY}, count(*) as n_orders,
        cast(count(*) filter (where prev_t is null or t_us - prev_t >= 300000000) as bigint) as n_blocks
        from seq group by all"""
    ),
)
def r0_concurrent(spark, sf):
    return plain(S.concurrent_blocks(clean(spark, sf), R.items(spark, sf)))


# Rules are recorded for the first order of each slot; all other orders are concurrent (R0).
HEADS = "decision not in ('first', 'R0')"


def _rule(name: str, column: str, extra: str = ""):
    cols = ["order_no", "anchor_no", *([extra] if extra else []), column]

    @query(name, oracle(f"select {', '.join(cols)} from fold where {HEADS}"))
    def run(spark, sf):
        return explain(spark, sf).filter(~F.col("decision").isin("first", "R0")).select(*cols)

    return run


_rule("r1_time_window", "r1", "since_first_us")
_rule("r2_amount_cap", "r2")
_rule("r3_reopen_gap", "r3", "gap_us")
_rule("r35_private_dinner_drinks", "r35")
_rule("weak_score", "score")
_rule("small_order", "small")
_rule("item_jaccard", "jaccard")


VALUES = ["gap_us", "since_first_us", "small", "r1", "r2", "r3", "r35", "jaccard", "score"]


@query(
    "merge_explain",
    oracle(
        f"""select order_no, store, table_name, {DAY}, group_no as group_id, case when {HEADS} then anchor_no else group_no end as anchor_no,
        {', '.join(f"case when {HEADS} then {c} end as {c}" for c in VALUES)}, decision from fold"""
    ),
)
def merge_explain(spark, sf):
    return plain(S.merge_explain(clean(spark, sf), R.items(spark, sf)))


@query(
    "drop_free_orders",
    oracle(
        """select store, count(*) as n_orders, cast(sum(revenue) as double) as revenue
        from clean_o where revenue > 0 group by store"""
    ),
)
def drop_free_orders(spark, sf):
    out = G.drop_free_orders(clean(spark, sf)).groupBy("store")
    return plain(out.agg(F.count(F.lit(1)).alias("n_orders"), F.sum("revenue").alias("revenue")))


GROUP_SQL = f"""group_id, store, table_name, {DAY}, n_orders, cast(revenue as double) as revenue,
  strftime(first_time, '%Y-%m-%d %H:%M:%S') as first_time, strftime(last_time, '%Y-%m-%d %H:%M:%S') as last_time,
  guests, item_count, member, opener, cast(per_capita as double) as per_capita"""
GROUP_COLS = [
    "group_id", "store", "table_name", "biz_date", "n_orders", "revenue", "first_time", "last_time",
    "guests", "item_count", "member", "opener", "per_capita",
]


@query("aggregate_groups", oracle(f"select {GROUP_SQL} from g"))
def aggregate_groups(spark, sf):
    return plain(groups(spark, sf).select(*GROUP_COLS))


@query("filter_status", oracle("select group_id, filter_status from g"))
def filter_status(spark, sf):
    return groups(spark, sf).select("group_id", "filter_status")


FUNNEL_SQL = """
  select store, {day} count(*) as raw_orders,
    count(*) filter (where contains(table_name, '外点自取')) as takeaway_orders,
    count(*) filter (where order_type <> '堂食' and not contains(table_name, '外点自取')) as not_dine_in_orders,
    count(*) filter (where order_type = '堂食' and not contains(table_name, '外点自取') and not readable) as invalid_orders,
    count(*) filter (where order_type = '堂食' and not contains(table_name, '外点自取') and readable and revenue <= 0) as free_orders,
    count(*) filter (where order_type = '堂食' and not contains(table_name, '外点自取') and readable and revenue > 0) as paid
  from (select *, regexp_full_match(order_no, '[0-9]+') and revenue is not null and order_time is not null as readable from o)
  group by all"""
FUNNEL_GROUPS_SQL = """
  select store, {day} count(*) as merged_groups,
    count(*) filter (where filter_status = 'no_per_capita') as no_per_capita_groups,
    count(*) filter (where filter_status = 'snack') as snack_groups,
    count(*) filter (where filter_status = 'packing') as packing_groups,
    count(*) filter (where filter_status = 'stray') as stray_groups,
    count(*) filter (where filter_status = 'bar') as bar_groups,
    count(*) filter (where filter_status = 'kept') as counted_groups
  from g group by all"""


def funnel_sql(daily: bool) -> str:
    raw = FUNNEL_SQL.format(day="cast(order_time as date) as d," if daily else "")
    grouped = FUNNEL_GROUPS_SQL.format(day="biz_date as d," if daily else "")
    using = "store, d" if daily else "store"
    day = "strftime(d, '%Y-%m-%d') as group_date," if daily else ""
    nums = [
        "raw_orders", "takeaway_orders", "not_dine_in_orders", "invalid_orders", "free_orders", "merged_groups", "no_per_capita_groups",
        "snack_groups", "packing_groups", "stray_groups", "bar_groups", "counted_groups",
    ]
    return f"""select store, {day} {', '.join(f'coalesce({n}, 0) as {n}' for n in nums)},
      coalesce(paid, 0) - coalesce(merged_groups, 0) as merged_away
      from ({raw}) a full join ({grouped}) b using ({using})"""


@query("order_count_funnel", oracle(funnel_sql(False)))
def order_count_funnel(spark, sf):
    return G.order_count_funnel(R.orders(spark, sf), groups(spark, sf), ["store"])
