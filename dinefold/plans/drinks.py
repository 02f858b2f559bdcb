"""Queries of drink statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinefold.operators import cleaning as C
from dinefold.operators import drinks as D
from dinefold.operators import takeaway as T
from dinefold.operators.groups import kept
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.merge import merged_and_groups
from dinefold.plans.out import plain
from dinefold.plans.periods import DRINKS, WEEK, paid_orders, role_sql, valid_takeaway, week_merged
from dinefold.plans.prelude import CTES, oracle

DIM = "case when category in ('调饮汁', '饮料和水果', '茶', '咖啡', '冰淇淋') then '非酒精' else '含酒精' end"
CTES["dsold"] = f"""
  select s.*, l.store, l.group_id, {DIM} as dimension from sold s join links l using (order_no) where category in {DRINKS}"""
CTES["dtotal"] = """
  select store, g as guests, r as total_revenue from (select store, sum(guests) as g from kept group by store)
  join (select store, sum(revenue) as r from (select store, revenue from clean_o where revenue > 0
    union all select store, revenue from tc where valid) group by store) using (store)"""


def inputs(spark, sf):
    """Sold lines of counted groups, those groups, paid orders and completed takeaway."""
    merged, groups = merged_and_groups(spark, sf)
    paid = merged.filter(F.col("revenue") > 0)
    links = paid.join(kept(groups).select("group_id"), "group_id", "left_semi").select("order_no", "store", "group_id")
    sold = C.sold_items(R.items(spark, sf)).join(links, "order_no")
    away = T.valid_orders(T.takeaway_clean(R.takeaway(spark, sf)))
    return sold, kept(groups), paid, away


@query("drink_scope", oracle(f"select {DIM} as dimension, category, count(*) as n_lines from i where category in {DRINKS} group by all"))
def drink_scope(spark, sf):
    return D.drink_scope(R.items(spark, sf)).groupBy("dimension", "category").agg(F.count(F.lit(1)).alias("n_lines"))


MEASURES = """n as n_groups, cast(q as double) as qty, cast(r as double) as revenue,
  cast(q as double) / guests as attach_rate, cast(r as double) / cast(total_revenue as double) as revenue_share"""
SUMS = "count(distinct group_id) as n, sum(qty) as q, sum(item_revenue) as r"


@query(
    "drink_category_stats",
    oracle(f"select store, dimension, category, {MEASURES} from (select store, dimension, category, {SUMS} from dsold group by all) join dtotal using (store)"),
)
def drink_category_stats(spark, sf):
    return plain(D.drink_category_stats(*inputs(spark, sf), ["store"]))


@query(
    "drink_dimension_stats",
    oracle(
        f"""select store, scope, {MEASURES} from (select store, dimension as scope, {SUMS} from dsold group by all
        union all select store, '全部', {SUMS} from dsold group by store) join dtotal using (store)"""
    ),
)
def drink_dimension_stats(spark, sf):
    return plain(D.drink_dimension_stats(*inputs(spark, sf), ["store"]))


CTES["dcmp"] = f"""
  select x.store, x.category, x.role, n, q, r, g, tot from (
    select store, category, role, {SUMS} from sold_role where role is not null and category in {DRINKS} group by all) x
  join (select store, role, sum(guests) as g from kept_role where role is not null group by all) y using (store, role)
  join (select store, role, sum(revenue) as tot from (
      select store, revenue, {role_sql('cast(order_time as date)')} as role from clean_o2 where revenue > 0
      union all select store, revenue, {role_sql('business_date')} from tc2 where valid) where role is not null group by all) z using (store, role)"""


@query(
    "drink_compare",
    oracle(
        """select k.store, k.category, k.role, cast(coalesce(d.n, 0) as double) as n_groups, cast(coalesce(d.q, 0) as double) as qty,
          cast(coalesce(d.r, 0) as double) as revenue, cast(d.q as double) / d.g as attach_rate,
          cast(d.r as double) / cast(d.tot as double) as revenue_share,
          cast(coalesce(d.q, 0) as double) / nullif(cast(c.q as double), 0) as qty_to_current,
          cast(coalesce(d.r, 0) as double) / nullif(cast(c.r as double), 0) as revenue_to_current
        from (select distinct store, category, role from (select distinct store, category from dcmp), (values ('current'), ('previous'), ('last_year')) v(role)) k
        left join dcmp d using (store, category, role)
        left join dcmp c on c.store = k.store and c.category = k.category and c.role = 'current'"""
    ),
)
def drink_compare(spark, sf):
    lines, groups = week_merged(spark, sf)
    away = valid_takeaway(spark, sf)
    return plain(D.drink_compare(C.sold_items(lines), groups, paid_orders(spark, sf), away, WEEK, ["store"]))
