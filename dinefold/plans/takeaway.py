"""Queries of takeaway statistics."""

from __future__ import annotations

from dinefold.operators import takeaway as T
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.out import plain
from dinefold.plans.prelude import oracle


def cleaned(spark, sf):
    return T.takeaway_clean(R.takeaway(spark, sf))


MONEY = ["order_amount", "item_discount", "order_discount", "platform_discount", "paid", "expense", "commission", "partial_refund", "revenue"]
TIMES = ["order_time", "accept_time", "delivered_time"]
TEXTS = ["store", "source", "serial_no", "takeaway_id", "cashier_order_no", "status", "delivery_status", "delivery_method"]
DETAIL = ", ".join(
    [*TEXTS, "strftime(business_date, '%Y-%m-%d') as business_date"]
    + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in TIMES]
    + [f"cast({c} as double) as {c}" for c in MONEY]
)


@query("takeaway_clean", oracle(f"select {DETAIL} from tc"))
def takeaway_clean(spark, sf):
    return plain(cleaned(spark, sf))


@query("takeaway_mask", oracle(f"select {DETAIL} from t"))
def takeaway_mask(spark, sf):
    return plain(T.takeaway_mask(R.takeaway(spark, sf)))


@query("takeaway_detail", oracle(f"select {DETAIL} from tc where valid"))
def takeaway_detail(spark, sf):
    return plain(T.takeaway_detail(cleaned(spark, sf)))


@query("takeaway_status", oracle("select store, source, takeaway_id, status, case when valid then 'valid' else 'returned' end as kind from tc"))
def takeaway_status(spark, sf):
    return T.takeaway_status(cleaned(spark, sf)).select("store", "source", "takeaway_id", "status", "kind")


def overview_sql(by: str, out: str | None = None) -> str:
    def money(c):
        return f"cast(coalesce(sum({c}) filter (where valid), 0) as double)"

    n = "count(*) filter (where valid)"
    group = f"group by {by}" if by else ""
    head = f"{out or by}, " if by else ""
    return f"""select {head}{n} as n_orders, count(*) filter (where not valid) as n_returned,
      {', '.join(f'{money(c)} as {c}' for c in ('order_amount', 'revenue', 'paid', 'commission', 'expense', 'partial_refund'))},
      {money('abs(item_discount) + abs(order_discount) + abs(platform_discount)')} as discount,
      {money('revenue')} / nullif({n}, 0) as average,
      abs({money('commission')}) / nullif({money('paid')}, 0) as commission_rate,
      abs({money('expense')}) / nullif({money('paid')}, 0) as expense_rate from tc {group}"""


DATE = "strftime(business_date, '%Y-%m-%d') as business_date"
_OVERVIEWS = {
    "takeaway_overview": ([], ""),
    "takeaway_by_store": (["store"], "store"),
    "takeaway_daily": (["business_date", "store"], f"{DATE}, store"),
    "takeaway_by_platform": (["business_date", "store", "source"], f"{DATE}, store, source"),
}


def _overview(name, by, out):
    @query(name, oracle(overview_sql(", ".join(by), out)))
    def run(spark, sf):
        return plain(T.takeaway_overview(cleaned(spark, sf), by))


for _name, (_by, _out) in _OVERVIEWS.items():
    _overview(_name, _by, _out)


@query(
    "takeaway_hourly",
    oracle(
        f"""with h as (select business_date, store, case when h < 16 then '午市' else '晚市' end as daypart, h, count(v.store) as n,
              coalesce(sum(v.revenue), 0) as r
            from (select distinct business_date, store from tc where valid) s cross join range(0, 24) x(h)
            left join (select business_date, store, hour(order_time) as h, revenue from tc where valid) v using (business_date, store, h) group by all)
        select {DATE}, store, daypart, cast(h as int) as order_hour, n as n_orders, cast(r as double) as revenue from h
        union all select {DATE}, store, daypart, -1, n, r
          from (select business_date, store, daypart, cast(sum(n) as bigint) as n, cast(sum(r) as double) as r from h group by all)"""
    ),
)
def takeaway_hourly(spark, sf):
    return plain(T.takeaway_hourly(cleaned(spark, sf), ["business_date", "store"]))


@query(
    "takeaway_fulfilment",
    oracle(
        """select store, cast(sum(a) as double) / count(a) / 60000000 as mean_accept, cast(sum(d) as double) / count(d) / 60000000 as mean_delivery,
          round(quantile_cont(d / 60000000, 0.5), 4) as p50_delivery, round(quantile_cont(d / 60000000, 0.9), 4) as p90_delivery,
          count(*) filter (where d > 2700000000) as n_late
        from (select store, epoch_us(accept_time) - epoch_us(order_time) as a,
            case when delivery_status = '已送达' then epoch_us(delivered_time) - epoch_us(order_time) end as d from tc where valid) group by store"""
    ),
)
def takeaway_fulfilment(spark, sf):
    return T.takeaway_fulfilment(cleaned(spark, sf), ["store"])


@query(
    "takeaway_exceptions",
    oracle(
        " union all ".join(
            f"select store, source, takeaway_id, '{reason}' as reason from tc where {cond}"
            for reason, cond in {
                "returned": "not valid",
                "awaiting_delivery": "delivery_status = '待配送'",
                "partial_refund": "partial_refund <> 0",
                "zero_amount": "order_amount = 0",
                "missing_times": "accept_time is null or delivered_time is null",
            }.items()
        )
    ),
)
def takeaway_exceptions(spark, sf):
    return T.takeaway_exceptions(cleaned(spark, sf))
