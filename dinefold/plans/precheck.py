"""The check of files against the stored history, before they are loaded."""

from __future__ import annotations

from dinefold.operators import validation as V
from dinefold.operators.cleaning import clean_orders
from dinefold.operators.sessions import with_slots
from dinefold.plans.catalog import query
from dinefold.plans.grids import CLOSURES
from dinefold.plans.periods import history
from dinefold.plans.validation import STEPS, goracle, periods

STEPS["gheld"] = "select distinct store, cast(order_time as date) as day from clean_o2 where order_time is not null"
STEPS["gcompared"] = """
  select file, store_name, role, s, s + 6 as e, cast(unnest(generate_series(cast(s as timestamp), cast(s + 6 as timestamp), interval 1 day)) as date) as day
  from (select file, store_name, role, cast(date_trunc('week', min(day)) as date) - back as s
    from gspine, (values ('previous', 7), ('last_year', 364)) v(role, back) group by file, store_name, role, back)"""


@query(
    "precheck_history",
    goracle(
        """select file, 'Info' as level, 'new_days' as code, cast(count(*) filter (where h.day is null) as varchar) as detail
          from gspine s left join gheld h on h.store = s.store_name and h.day = s.day group by file
        union all select file, 'Info', 'existing_days', format('{} ({}~{})', count(*), min(day), max(day))
          from gspine s join gheld h using (day) where h.store = s.store_name group by file
        union all select file, 'Warning', 'little_history', format('{} {}~{}: {}', role, s, e, count(*)) from gcompared c
          where not exists (select 1 from gheld h where h.store = c.store_name and h.day = c.day)
            and not exists (select 1 from gclosed x where x.closed = c.day and x.store in ('_all_stores', c.store_name))
          group by file, role, s, e"""
    ),
)
def precheck_history(spark, sf):
    # Days and stores only, so the orders need neither lines nor a merge.
    known = with_slots(clean_orders(history(spark, sf)))
    return V.precheck_history(periods(spark, sf), known, V.closures_frame(spark, CLOSURES), "week")
