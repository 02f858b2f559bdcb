"""Queries of the reports and daily marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinefold.operators import cleaning as C
from dinefold.operators import marts as M
from dinefold.operators import reports as RP
from dinefold.operators.groups import kept
from dinefold.plans import roles as R
from dinefold.plans.anomalies import counted, counted_once
from dinefold.plans.catalog import query
from dinefold.plans.grids import grid
from dinefold.plans.merge import funnel_sql, groups, merged_and_groups
from dinefold.plans.out import plain
from dinefold.plans.prelude import CTES, oracle
from dinefold.plans.validation import goracle
from dinefold.plans.visits import linked


def overview_sql(by: str, tab: str = "kept") -> str:
    """One select per level, each with its parent's revenue."""
    base = f"select {by}, {{0}} as daypart, {{1}} as area, count(*) as n, sum(revenue) as r, sum(guests) as g from {tab} group by all"
    total, part = base.format("'全部'", "'全部'"), base.format("daypart", "'全部'")
    return f"""
      select {by}, daypart, area, n as n_groups, cast(r as double) as revenue, cast(g as bigint) as guests,
        cast(r as double) / cast(p as double) as share, cast(r as double) / g as per_capita from (
        select *, r as p from ({total})
        union all select a.*, t.r from ({base.format("'全部'", "area")}) a join ({total}) t using ({by})
        union all select a.*, t.r from ({part}) a join ({total}) t using ({by})
        union all select a.*, t.r from ({base.format("daypart", "area")}) a join ({part}) t using ({by}, daypart))"""


@query("overview", oracle(overview_sql("store")))
def overview(spark, sf):
    return plain(RP.overview(counted(spark, sf), ["store"]))


MEMBER_SQL = """select {by}, member, count(*) as n_groups, cast(sum(revenue) as double) as revenue,
  cast(sum(guests) as bigint) as guests, cast(sum(revenue) as double) / sum(guests) as per_capita from kept group by all"""


@query("member_split", oracle(MEMBER_SQL.format(by="store")))
def member_split(spark, sf):
    return plain(RP.member_split(counted(spark, sf), ["store"]))


BAND = """case when per_capita >= 300 then '300+' when per_capita >= 200 then '200-300' when per_capita >= 150 then '150-200'
  when per_capita >= 100 then '100-150' else '<100' end"""
CTES["banded"] = f"select *, {BAND} as bucket from kept"
BANDS = "(values ('300+'), ('200-300'), ('150-200'), ('100-150'), ('<100')) b(bucket)"


def buckets_sql(by: str, out: str) -> str:
    return f"""select {out}, bucket, coalesce(n, 0) as n_groups, cast(coalesce(n, 0) as double) / n_all as share
      from (select {by}, count(*) as n_all from banded group by all) t cross join {BANDS}
      left join (select {by}, bucket, count(*) as n from banded group by all) c using ({by}, bucket)"""


@query("price_buckets", oracle(buckets_sql("store", "store")))
def price_buckets(spark, sf):
    return RP.price_buckets(counted(spark, sf), ["store"])


OPENER = "case when opener = '顾客/系统' then '扫码点餐' else opener end"


@query(
    "bucket_openers",
    oracle(
        f"""select store, bucket, opener, n as n_groups, cast(row_number() over (partition by store, bucket order by n desc, opener) as int) as position,
          concat(opener, '(', n, ')') as label
        from (select store, bucket, {OPENER} as opener, count(*) as n from banded where bucket in ('300+', '200-300') group by all)"""
    ),
)
def bucket_openers(spark, sf):
    return RP.bucket_openers(counted(spark, sf), ["store"])


@query(
    "opener_stats",
    oracle(
        f"""select store, {OPENER} as opener_name, count(*) as n_groups, cast(sum(revenue) as double) as revenue from kept group by all
        union all select store, '合计', count(*), cast(sum(revenue) as double) from kept group by store"""
    ),
)
def opener_stats(spark, sf):
    return plain(RP.opener_stats(counted(spark, sf), ["store"]))


@query(
    "visitor_stats",
    oracle("select store, waiter as waiter_name, count(*) as n_visits from v group by all union all select store, '合计', count(*) from v group by store"),
)
def visitor_stats(spark, sf):
    return RP.visitor_stats(R.visits(spark, sf), ["store"])


# Listed dishes with their aliases, here by the part names of the given data.
DISHES = {
    "red widget": ["red widget（杯）", "red widget大瓶"],
    "blue bolt": ["blue bolt（黄啤）", "small bolt"],
    "small ring": [],
    "green gear": ["green gear（杯）"],
}
DISH_CASE = "case " + " ".join(
    f"when name in ({', '.join(repr(n) for n in [d, *names])}) then '{d}'" for d, names in DISHES.items()
) + " end"
CTES["sold"] = "select * from i where item_revenue > 0 and sale_type is distinct from '套餐'"
CTES["sold2"] = "select * from i2 where item_revenue > 0 and sale_type is distinct from '套餐'"


CTES["links"] = """
  select m.order_no, m.store, m.biz_date, m.order_time, m.revenue, m.group_no as group_id, m.decision, k.daypart as group_daypart
  from merged m join kept k on k.group_id = m.group_no where m.revenue > 0"""


def links(spark, sf):
    merged, g = merged_and_groups(spark, sf)
    return RP.group_orders(merged, kept(g))


def counted_lines(spark, sf):
    """Sold lines of counted orders, with the store and daypart of their group."""
    of = links(spark, sf).select("order_no", "store", F.col("group_daypart").alias("daypart"))
    return C.sold_items(R.items(spark, sf)).join(of, "order_no")


@query(
    "dish_sales",
    oracle(
        f"""select l.store, {DISH_CASE} as dish, cast(sum(qty) as double) as qty from sold join links l using (order_no)
        where {DISH_CASE} is not null group by all"""
    ),
)
def dish_sales(spark, sf):
    return plain(RP.dish_sales(counted_lines(spark, sf), DISHES, ["store"]))


@query(
    "daypart_top6",
    oracle(
        """select * from (select store, daypart, name, cast(qty as double) as qty,
            cast(row_number() over (partition by store, daypart order by qty desc, name) as int) as position
          from (select l.store, l.group_daypart as daypart, name, sum(qty) as qty from sold s join links l using (order_no) group by all))
        where position <= 6"""
    ),
)
def daypart_top6(spark, sf):
    return plain(RP.daypart_top(counted_lines(spark, sf), ["store"]))


TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"


@query(
    "order_index",
    oracle(
        f"""select store, table_name, strftime(biz_date, '%Y-%m-%d') as biz_date, {TIME.format('first_time')}, {TIME.format('last_time')},
          {TIME.format('last_checkout')}, group_id, n_orders, item_count, guests, cast(amount as double) as amount,
          cast(revenue as double) as revenue, cast(per_capita as double) as per_capita, member, opener,
          per_capita < case when store = '保利店' then 40 else 100 end as red_line from kept"""
    ),
)
def order_index(spark, sf):
    return plain(RP.order_index(counted(spark, sf)))


@query(
    "group_detail",
    oracle(
        """select group_id, 'order' as part, order_no, decision as name, cast(null as double) as qty, cast(revenue as double) as value from links
        union all select l.group_id, 'item', i.order_no, name, cast(qty as double), cast(item_revenue as double)
          from i join links l using (order_no) where item_revenue > 0
        union all select l.group_id, case when amount_matched then 'visit_by_match' else 'visit' end, l.order_no, v.transcript, null, l.satisfaction
          from linked l join kept k using (group_id) join v using (visit_id)"""
    ),
)
def group_detail(spark, sf):
    merged, g = merged_and_groups(spark, sf)
    k = kept(g)
    return plain(RP.group_detail(k, RP.group_orders(merged, k), R.items(spark, sf), linked(spark, sf, merged)))


@query(
    "top_bottom_groups",
    oracle(
        """select * from (
          select store, group_id, cast(per_capita as double) as per_capita, 'highest' as which,
            cast(row_number() over (partition by store order by per_capita desc, group_id) as int) as position from kept
          union all select store, group_id, cast(per_capita as double), 'lowest',
            cast(row_number() over (partition by store order by per_capita, group_id) as int) from kept) where position <= 3"""
    ),
)
def top_bottom_groups(spark, sf):
    out = RP.top_bottom_groups(counted_once(spark, sf), ["store"])
    return plain(out.select("store", "group_id", "per_capita", "which", "position"))


@query(
    "per_capita_rank",
    oracle(
        """select store, strftime(biz_date, '%Y-%m-%d') as biz_date, group_id, cast(per_capita as double) as per_capita,
          rank() over (partition by store, biz_date order by per_capita desc) as per_capita_rank from kept"""
    ),
)
def per_capita_rank(spark, sf):
    out = RP.per_capita_rank(counted_once(spark, sf), ["store", "biz_date"])
    return plain(out.select("store", "biz_date", "group_id", "per_capita", "per_capita_rank"))


# --- marts ---------------------------------------------------------------------

DAY = "strftime(biz_date, '%Y-%m-%d') as biz_date"


@query(
    "daily_overview",
    oracle(
        f"""select store, {DAY}, case when daypart = '全部' and area = '全部' then 'total' when daypart = '全部' then 'area'
            when area = '全部' then 'daypart' else 'daypart:' || daypart end as category,
          case when daypart = '全部' and area = '全部' then '全部' when area = '全部' then daypart else area end as sub_category,
          n_groups, revenue, guests, per_capita from ({overview_sql('store, biz_date')})
        union all select store, {DAY}, 'member', case when member then 'member' else 'non_member' end, n_groups, revenue, guests, per_capita
          from ({MEMBER_SQL.format(by='store, biz_date')})"""
    ),
)
def daily_overview(spark, sf):
    return plain(M.daily_overview(counted_once(spark, sf)))


@query("daily_order_counts", oracle(funnel_sql(True)))
def daily_order_counts(spark, sf):
    return plain(M.daily_order_counts(R.orders(spark, sf), groups(spark, sf)))


@query("daily_buckets", oracle(buckets_sql("store, biz_date", f"store, {DAY}")))
def daily_buckets(spark, sf):
    return plain(M.daily_buckets(counted(spark, sf)))


@query(
    "daily_opener_stats",
    oracle(f"select store, {DAY}, {OPENER} as opener_name, count(*) as n_groups, cast(sum(revenue) as double) as revenue from kept group by store, biz_date, opener"),
)
def daily_opener_stats(spark, sf):
    return plain(M.daily_opener_stats(counted(spark, sf)))


@query(
    "store_by_content",
    goracle(
        """select file, store_name, case when contains(file, '万荷') then '万荷店' when contains(file, '保利') then '保利店'
          when contains(file, '湾里') then '湾里店' end as name_in_file,
          coalesce(store_name <> case when contains(file, '万荷') then '万荷店' when contains(file, '保利') then '保利店'
          when contains(file, '湾里') then '湾里店' end, false) as mismatch from gperiod"""
    ),
)
def store_by_content(spark, sf):
    return M.store_by_content(grid(spark, sf))
