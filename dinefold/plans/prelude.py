"""The roles and shared steps restated as DuckDB SQL, for the oracles.

Each entry is a common table expression. `oracle(body)` puts the ones a query needs in front.
"""

from __future__ import annotations

import re

from dinefold import params as P
from dinefold.params import MergeParams


def _words(ws) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


ORDER_COLS = """
    cast(event_id as varchar) as order_no, store, ts as order_time,
    case when k < 95 then ts + to_minutes(k) end as checkout_time,
    cast(value + k % 7 as decimal(18,2)) as amount,
    case when k % 25 = 13 then cast(0 as decimal(18,2)) else value end as revenue,
    k % 6 + 1 as guests,
    case when event_type = 'signup' then '外带' else '堂食' end as order_type,
    case when k = 99 then '外点自取' else
      case user_id % 4 when 0 then case when store = '保利店' then '包房' else '包间' end
                       when 1 then case when store = '保利店' then '沙发' else '大厅' end
                       when 2 then '户外' else '吧台' end || cast(user_id as varchar) end as table_name,
    case when k % 20 = 0 then '-' else '1380000' || cast(k % 20 as varchar) end as member_phone,
    case k % 3 when 0 then '-' when 2 then 'M' || cast(user_id as varchar) end as member_name,
    case k % 4 when 0 then '微信' when 1 then '微信+会员卡' when 2 then '支付宝,现金' else '-' end as pay_method,
    case k % 5 when 0 then '少辣' when 1 then '不要香菜' else '' end as remark,
    case when event_type = 'error' then '顾客/系统' else event_type end as opener
"""

CTES: dict[str, str] = {}

CTES["ev"] = """
  select event_id, ts, user_id, event_type, cast(value as decimal(18,2)) as value,
         cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
         case user_id % 3 when 0 then '万荷店' when 1 then '保利店' else '湾里店' end as store
  from events"""
CTES["ev2"] = f"""
  select * from ev union all
  select event_id + 1000000000000, ts - interval 364 day, user_id, event_type,
         cast(value * 0.8 as decimal(18,2)), k, store from ev"""
CTES["o"] = f"select {ORDER_COLS} from ev"
CTES["o2"] = f"select {ORDER_COLS} from ev2"
CTES["i"] = """
  select cast(l_orderkey as varchar) as order_no, l_linenumber as seq,
    'SKU' || cast(l_partkey as varchar) as sku,
    case when p_type = 'SMALL' and p_size % 5 = 0 then '打包盒' || p_name else p_name ||
      case p_size % 4 when 0 then '（杯）' when 1 then '大瓶' when 2 then '（黄啤）' else '' end end as name,
    case p_type when 'STANDARD' then '茶' when 'MEDIUM' then '啤酒' when 'PROMO' then '咖啡'
      when 'ECONOMY' then '对外售卖零食' when 'LARGE' then '炒菜' else '汤' end as category,
    p_brand as spec,
    case when p_size % 10 = 0 then '套餐' when l_linestatus = 'F' then '套餐子项'
         when p_size % 10 <> 1 then '单品' end as sale_type,
    cast(l_quantity as decimal(18,2)) as qty,
    cast(l_extendedprice as decimal(18,2)) as line_amount,
    case when l_returnflag = 'R' then cast(0 as decimal(18,2)) else
      cast(cast((cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)
        * (100 - cast(round(l_discount * 100) as int)) + 50) // 100 as decimal(18,0)) * 0.01 as decimal(18,2)) end
      as item_revenue
  from lineitem join part on l_partkey = p_partkey"""
CTES["i2"] = """
  select * from i union all
  select * replace (cast(cast(order_no as bigint) + 1000000000000 as varchar) as order_no) from i"""
CTES["v"] = """
  select e.event_id as visit_id,
    case e.event_id % 5 when 1 then null when 2 then 'U' || cast(e.event_id as varchar) when 3 then ' '
      else cast(e.event_id as varchar) end as order_no,
    store, case when k % 10 = 9 then 'ZZ' else cast(user_id as varchar) end as table_name,
    k * 7 % 6 + 1 as guests,
    cast(case k % 4 when 0 then value + k % 7 when 1 then value when 2 then value + 0.30 else 99999 end
      as decimal(18,2)) as paid,
    case when k % 17 <> 16 then ts + to_minutes(k % 13 - 6) end as order_time,
    'W' || cast(user_id % 7 as varchar) as waiter,
    case when k % 3 = 0 then '会员' else '非会员' end as member_status,
    c.text as transcript, cast(k % 5 + 1 as double) as satisfaction, ts + to_minutes(60) as created_at
  from ev e left join (select conv_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id) c
    on c.conv_id = e.event_id"""
TAKEAWAY_COLS = """
  select store,
    case event_type when 'view' then '美团外卖' when 'click' then '淘宝闪购餐饮外卖' else '饿了么' end as source,
    '#' || cast(event_id as varchar) as serial_no,
    case when k = 98 then '-' else cast(event_id // 2 as varchar) end as takeaway_id,
    'P' || cast(event_id as varchar) as cashier_order_no,
    ts as order_time, cast(ts as date) as business_date,
    case when k % 19 <> 18 then ts + to_minutes(k % 5) end as accept_time,
    case when k < 95 then ts + to_minutes(k) end as delivered_time,
    case when k < 85 then '已完成' when k < 95 then '已退单' else '已取消' end as status,
    case when k % 11 = 10 then '待配送' else '已送达' end as delivery_status,
    case when k % 2 = 0 then '美团配送' else '淘宝闪购配送' end as delivery_method,
    cast(case when k = 50 then 0 else value end as decimal(18,2)) as order_amount,
    -(k % 4) as item_discount, -(k % 3) as order_discount, -(k % 2) as platform_discount,
    cast(case when k % 40 = 7 then 0 else value - k % 4 end as decimal(18,2)) as paid,
    -(k % 9) as expense, -(k % 8) as commission,
    case when k % 30 = 5 then 3 else 0 end as partial_refund, value as revenue
  from {src}"""
CTES["t"] = TAKEAWAY_COLS.format(src="ev")
CTES["t2"] = TAKEAWAY_COLS.format(src="ev2")

for _n in ("", "2"):
    CTES[f"tc{_n}"] = f"""
  select * exclude (rn), status = '已完成' as valid from (select *, row_number() over (
    partition by store, source, takeaway_id order by order_time desc, serial_no desc) as rn from t{_n} where takeaway_id <> '-') where rn = 1"""
    CTES[f"clean_o{_n}"] = f"""
  select * from o{_n} where order_type = '堂食' and not contains(table_name, '外点自取')"""
    CTES[f"feat{_n}"] = f"""
  select order_no, count(*) as line_cnt, bool_and(category in {_words(P.DRINK_CATEGORIES)}) as all_drinks,
    count(*) filter (where category = '对外售卖零食') as snack_lines,
    count(*) filter (where contains(name, '打包')) as packing_lines, list(distinct name) as names
  from i{_n} group by order_no"""
    CTES[f"seq{_n}"] = f"""
  select c.*, cast(order_time as date) as biz_date, epoch_us(order_time) as t_us,
    epoch_us(checkout_time) as checkout_us,
    coalesce(line_cnt, 0) as line_cnt, coalesce(all_drinks, false) as all_drinks,
    coalesce(snack_lines, 0) as snack_lines, coalesce(packing_lines, 0) as packing_lines,
    coalesce(names, []) as names,
    nullif(member_phone, '-') as phone, nullif(remark, '') as rem,
    list_filter(regexp_split_to_array(pay_method, '[+,]'), lambda x: x <> '-') as pays,
    hour(order_time) as hr,
    (contains(table_name, '包间') or contains(table_name, '包房')) as private,
    row_number() over w as rn,
    lag(epoch_us(order_time)) over w as prev_t, lag(epoch_us(checkout_time)) over w as prev_out
  from clean_o{_n} c left join feat{_n} f using (order_no)
  window w as (partition by store, table_name, cast(order_time as date) order by order_time, order_no)"""


def fold_cte(p: MergeParams = MergeParams(), n: str = "") -> str:
    """The merge as a recursion over the orders of a table-day, one order per step."""
    min_us = 60_000_000
    return f"""
  select order_no, store, table_name, biz_date, rn, rn as a_rn, order_no as group_no, 'first' as decision,
    order_no as anchor_no,
    cast(null as bigint) as gap_us, cast(null as bigint) as since_first_us, false as small, false as r0, false as r1,
    false as r2, false as r3, false as r35, cast(0 as double) as jaccard, cast(0 as integer) as score
  from seq{n} where rn = 1
  union all
  select order_no, store, table_name, biz_date, rn,
    case when decision in ('R0', 'R3.5', 'score_merge') then a_rn else rn end,
    case when decision in ('R0', 'R3.5', 'score_merge') then group_no else order_no end,
    decision, anchor_no, gap_us, since_first_us, small, r0, r1, r2, r3, r35, jaccard, score
  from (
   select *, case when r0 then 'R0' when r1 then 'R1' when r2 then 'R2' when r3 then 'R3' when r35 then 'R3.5'
     when score >= {p.score_threshold} then 'score_merge' else 'score_split' end as decision
   from (
    select *,
     gap_us < {p.concurrent_minutes * min_us} as r0,
     since_first_us > (case when private then {p.window_hours_private} else {p.window_hours_regular} end)
       * cast({60 * min_us} as bigint) and not small as r1,
     revenue > a_revenue * {p.add_on_max_ratio} and a_revenue > {p.anchor_min_amount} as r2,
     coalesce(t_us - prev_out > (case when private then {p.reopen_min_private} else {p.reopen_min_regular} end)
       * cast({min_us} as bigint) and not small, false) as r3,
     private and hr >= {p.dinner_start_hour} and hr < {p.dinner_end_hour} and all_drinks as r35,
     cast(20 + (case when gap_us <= {30 * min_us} then 25 when gap_us <= {60 * min_us} then 10 else 0 end)
       + (case when phone = a_phone then 25 when phone <> a_phone then -10 else 0 end)
       + (case when guests = a_guests then 15 else 0 end)
       + (case when list_has_any(pays, a_pays) then 5 else 0 end)
       + (case when jaccard >= 0.1 then 10 else 0 end)
       + (case when not small then 0 when revenue < 40 then {p.small_bonus_low}
            when revenue < 60 then {p.small_bonus_mid} else {p.small_bonus_high} end)
       + (case when rem = a_rem then 5 else 0 end) as integer) as score
    from (
     select c.*, f.a_rn, f.group_no, a.order_no as anchor_no, a.revenue as a_revenue, a.phone as a_phone,
       a.guests as a_guests, a.pays as a_pays, a.rem as a_rem,
       c.t_us - c.prev_t as gap_us, c.t_us - a.t_us as since_first_us,
       c.revenue <= a.revenue * {p.small_ratio} or c.line_cnt <= {p.small_line_cnt} as small,
       coalesce(cast(len(list_intersect(c.names, a.names)) as double)
         / nullif(len(list_distinct(list_concat(c.names, a.names))), 0), 0) as jaccard
     from fold{n} f
     join seq{n} c on c.store = f.store and c.table_name = f.table_name and c.biz_date = f.biz_date and c.rn = f.rn + 1
     join seq{n} a on a.store = f.store and a.table_name = f.table_name and a.biz_date = f.biz_date and a.rn = f.a_rn
    )))"""


for _n in ("", "2"):
    CTES[f"fold{_n}"] = fold_cte(n=_n)
    CTES[f"merged{_n}"] = f"""
  select s.*, f.group_no, f.decision from seq{_n} s join fold{_n} f using (order_no)"""
    CTES[f"g{_n}"] = f"""
  select *, case when per_capita <= 0 then 'no_per_capita'
      when item_count > 0 and snack_lines = item_count then 'snack'
      when item_count > 0 and packing_lines = item_count then 'packing'
      when guests = 1 and item_count = 1 and revenue < 100 then 'stray'
      when contains(table_name, '吧台') then 'bar' else 'kept' end as filter_status,
    case when hour(first_time) < 16 then '午市' else '晚市' end as daypart,
    case when store = '保利店' then
      case when contains(table_name, '包房') then '包房' when contains(table_name, '沙发') then '沙发'
           when contains(table_name, '户外') then '户外' else '其他' end
    else case when contains(table_name, '包间') then '包间' when contains(table_name, '大厅') then '大厅'
           when contains(table_name, '户外') then '户外' else '其他' end end as area
  from (
   select *, cast(((2 * cast(revenue * 100 as bigint) + guests) // (2 * guests)) * 0.01 as decimal(18,2)) as per_capita
   from (
    select store, table_name, biz_date, group_no as group_id, count(*) as n_orders,
      cast(sum(revenue) as decimal(18,2)) as revenue, cast(sum(amount) as decimal(18,2)) as amount,
      min(order_time) as first_time, max(order_time) as last_time, max(checkout_time) as last_checkout,
      first(guests order by revenue desc, t_us, guests desc) as guests,
      first(opener order by t_us, order_no) as opener,
      cast(sum(line_cnt) as bigint) as item_count, cast(sum(snack_lines) as bigint) as snack_lines,
      cast(sum(packing_lines) as bigint) as packing_lines, bool_or(coalesce(member_name, '-') <> '-') as member
    from merged{_n} where revenue > 0 group by all))"""
    CTES[f"kept{_n}"] = f"select * from g{_n} where filter_status = 'kept'"


def oracle(body: str, **extra: str) -> str:
    """body with every common table expression it needs, in order of need."""
    ctes = {**CTES, **{k: v for k, v in extra.items()}}
    order: list[str] = []
    body = body.strip()
    if body.startswith("with "):
        body = f"select * from ({body})"

    def visit(text: str, self_name: str = ""):
        for name in ctes:
            if name != self_name and name not in order and re.search(rf"\b(?:from|join)\s+{name}\b", text, re.I):
                visit(ctes[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    return "with recursive " + ",\n".join(f"{n} as ({ctes[n]})" for n in order) + "\n" + body.strip()
