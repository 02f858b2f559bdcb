"""Queries that link visits to orders and groups."""

from __future__ import annotations

from dinefold.operators import groups as G
from dinefold.operators import sessions as S
from dinefold.operators import visits as V
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.merge import clean, merged_and_groups
from dinefold.plans.out import plain
from dinefold.plans.prelude import CTES, oracle
from dinefold.session import stored

CTES["exact"] = "select visit_id, v.order_no from v join clean_o o on o.order_no = v.order_no"
CTES["two3"] = """
  select visit_id, order_no, n as n_conditions, diff as diff_us from (
    select *, row_number() over (partition by visit_id order by n desc, diff nulls last, order_no) as rn from (
      select visit_id, order_no, c_table + c_amount + c_time as n, diff, c_time, same_day from (
        select l.visit_id, o.order_no,
          case when contains(o.table_name, l.table_name) then 1 else 0 end as c_table,
          case when floor(l.paid + 0.5) in (floor(o.amount + 0.5), floor(o.revenue + 0.5)) then 1 else 0 end as c_amount,
          case when abs(epoch_us(l.order_time) - epoch_us(o.order_time)) <= 300000000 then 1 else 0 end as c_time,
          abs(epoch_us(l.order_time) - epoch_us(o.order_time)) as diff,
          cast(coalesce(l.order_time, l.created_at) as date) = cast(o.order_time as date) as same_day
        from (select * from v where visit_id not in (select visit_id from exact)) l join clean_o o on o.store = l.store)
    ) where n >= 2 and (c_time = 1 or same_day)) where rn = 1"""
CTES["matches"] = "select visit_id, order_no, false as amount_matched from exact union all select visit_id, order_no, true from two3"
CTES["linked"] = """
  select m.visit_id, m.order_no, m.amount_matched, f.group_no as group_id, v.waiter, v.guests as visit_guests, v.satisfaction,
    v.created_at from matches m join merged f on f.order_no = m.order_no join v on v.visit_id = m.visit_id"""
CTES["corrected"] = """
  select k.* replace (coalesce(l.visit_guests, k.guests) as guests), k.guests as pos_guests,
    coalesce(l.visit_guests <> k.guests, false) as guests_corrected
  from kept k left join (select group_id, visit_guests from (select *, row_number() over (
    partition by group_id order by created_at desc, visit_id desc, visit_guests desc) as rn from linked) where rn = 1) l using (group_id)"""


def inputs(spark, sf):
    """Visits and clean orders, written once: matching reads them along several keys."""
    return stored(R.visits(spark, sf), "visits"), orders_to_match(spark, sf)


def orders_to_match(spark, sf):
    return stored(clean(spark, sf).select(*V.ORDER_COLUMNS), "orders")


def linked(spark, sf, merged):
    visits, orders = inputs(spark, sf)
    return V.visit_associate(visits, V.match_visits(visits, orders), merged)


@query("visit_exact_match", oracle("select visit_id, order_no from exact"))
def visit_exact_match(spark, sf):
    return V.visit_exact_match(R.visits(spark, sf), clean(spark, sf))


@query("visit_two_of_three", oracle("select visit_id, order_no, cast(n_conditions as int) as n_conditions, diff_us from two3"))
def visit_two_of_three(spark, sf):
    return V.visit_two_of_three(R.visits(spark, sf), orders_to_match(spark, sf))


@query(
    "visit_unmatched",
    oracle(
        """select visit_id, waiter, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, table_name, guests,
          cast(paid as double) as paid, strftime(order_time, '%Y-%m-%d %H:%M:%S') as order_time, member_status, transcript
        from v where visit_id not in (select visit_id from matches)"""
    ),
)
def visit_unmatched(spark, sf):
    visits, orders = inputs(spark, sf)
    return plain(V.visit_unmatched(visits, V.match_visits(visits, orders)))


@query("visit_associate", oracle("select visit_id, order_no, group_id, amount_matched, waiter, visit_guests, satisfaction from linked"))
def visit_associate(spark, sf):
    merged = S.session_merge(clean(spark, sf), R.items(spark, sf))
    out = linked(spark, sf, merged)
    return out.select("visit_id", "order_no", "group_id", "amount_matched", "waiter", "visit_guests", "satisfaction")


@query(
    "guest_correction",
    oracle(
        """select group_id, pos_guests, guests, guests_corrected,
          ((2 * cast(revenue * 100 as bigint) + guests) // (2 * guests)) / 100.0 as per_capita from corrected"""
    ),
)
def guest_correction(spark, sf):
    merged, groups = merged_and_groups(spark, sf)
    out = V.guest_correction(G.kept(groups), linked(spark, sf, merged))
    return plain(out.select("group_id", "pos_guests", "guests", "guests_corrected", "per_capita"))


@query(
    "visit_coverage",
    oracle(
        """select store, count(*) as n_groups, count(*) filter (where seen) as n_visited,
          cast(count(*) filter (where seen) as double) / count(*) as coverage
        from (select store, group_id in (select group_id from linked) as seen from kept) group by store"""
    ),
)
def visit_coverage(spark, sf):
    merged, groups = merged_and_groups(spark, sf)
    return V.visit_coverage(G.kept(groups), linked(spark, sf, merged), ["store"])
