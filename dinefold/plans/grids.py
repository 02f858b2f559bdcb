"""Raw grids derived from the events role: one file per store and week, with planned faults.

The grid is stated once, as SQL for both engines; only spellings differ between them.
Faults: a missing column (store B, week 2), a missing day (store C, week 3), no items sheet
(store A, week 4), no header keyword (store B, week 4), a range that is no date (store C,
week 4), no declared range (store C, week 1); the last week is incomplete for all stores.
"""

from __future__ import annotations

from dinefold import params as P
from dinefold.plans import roles as R

SPARK = {
    "L": "array(", "R": ")", "CAT": "concat", "S": "string", "EMPTY": "cast(array() as array<string>)",
    "MONDAY": "cast(date_trunc('week', ts) as date)", "TO_TEXT": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')",
    "TO_DAY": "date_format({0}, 'yyyy-MM-dd')", "PLUS6": "date_add(monday, 6)", "IDIV": "div",
    "WEEK": "datediff(monday, date'2024-01-01') div 7", "MIN": "ts + make_dt_interval(0, 0, {0}, 0)",
    "ROW": "named_struct('row_idx', {0}, 'cells', {1})", "EXPLODE": "explode",
}
DUCK = {
    "L": "[", "R": "]", "CAT": "list_concat", "S": "varchar", "EMPTY": "cast([] as varchar[])",
    "MONDAY": "cast(date_trunc('week', ts) as date)", "TO_TEXT": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
    "TO_DAY": "strftime({0}, '%Y-%m-%d')", "PLUS6": "monday + 6", "IDIV": "//",
    "WEEK": "date_diff('day', date '2024-01-01', monday) // 7", "MIN": "ts + to_minutes({0})",
    "ROW": "struct_pack(row_idx := {0}, cells := {1})", "EXPLODE": "unnest",
}

CLOSURES = {P.ALL_STORES: ["2024-02-01"], P.STORE_A: ["2024-02-02"], P.STORE_B: []}
SCHEMA = {
    "pos_orders": {
        "required": [
            "订单号", "下单时间", "结账时间", "订单金额", "订单收入", "就餐人数", "订单类型", "桌台", "会员手机号", "支付方式",
            "整单备注", "门店名称",
        ],
        "nullable": ["整单备注"],
    },
    "pos_items": {"required": ["订单号", "商品名称", "商品中类", "规格", "单价", "数量", "备用"], "nullable": ["规格"]},
}

BIG = "cast(1000000000000000 as bigint)"


def sql(d: dict) -> dict[str, str]:
    """Tables by name, in order of need; `ev` and `li` are the events and line items."""

    def arr(*xs):
        return d["L"] + ", ".join(xs) + d["R"]

    def text(*names):
        return arr(*[f"'{n}'" for n in names])

    def cat(a, b):
        return f"{d['CAT']}({a}, {b})"

    s = d["S"]

    def cast(x):
        return f"cast({x} as {s})"

    ts, out = d["TO_TEXT"].format("ts"), d["TO_TEXT"].format(d["MIN"].format("k"))
    start, end = d["TO_DAY"].format("monday"), d["TO_DAY"].format(d["PLUS6"])
    null = f"cast(null as {s})"
    phone = "case when k % 20 = 0 then '-' else concat('1380000', " + cast("k % 20") + ") end"
    table = "concat('大厅', " + cast("user_id") + ")"
    tables = {}
    tables["gev"] = f"select *, {d['MONDAY']} as monday from ev"
    tables["gw"] = f"""
      select *, {d['WEEK']} as week, case store when '万荷店' then '万荷' when '保利店' then '保利' else '湾里店' end as short,
        case store when '万荷店' then '万荷餐厅' when '保利店' then '保利广场店' else '湾里店' end as store_raw,
        concat({start}, '+00_00_00~', {end}, '+23_59_59.xlsx') as tail,
        case when store = '湾里店' and {d['WEEK']} = 3 then '2024-02-30 00:00:00~2024-02-31 23:59:59'
          else concat({start}, ' 00:00:00~', {end}, ' 23:59:59') end as declared
      from gev"""
    tables["gf"] = "select distinct store, week, short, store_raw, tail, declared from gw"
    pos = "concat(short, '店内订单明细', tail)"
    no_phone = "store = '保利店' and week = 1"
    head = cat(
        cat(
            "case when store = '保利店' and week = 3 then " + text("序号", "单号") + " else " + text("序号", "订单号") + " end",
            text("下单时间", "结账时间", "订单金额", "订单收入", "就餐人数", "订单类型", "桌台"),
        ),
        cat(f"case when {no_phone} then {d['EMPTY']} else {text('会员手机号')} end", text("支付方式", "整单备注", "备用")),
    )
    line = cat(
        arr(
            cast("event_id"), cast("event_id"), ts, f"case when k < 95 then {out} end", cast("value + k % 7"), cast("value"),
            cast("k % 6 + 1"), "case when event_type = 'signup' then '外带' else '堂食' end", table,
        ),
        cat(
            f"case when {no_phone} then {d['EMPTY']} else {arr(phone)} end",
            arr(
                "case k % 4 when 0 then '微信' when 1 then '支付宝' when 2 then ' ' else '-' end",
                "case k % 5 when 0 then '少辣' else 'NaN' end", null,
            ),
        ),
    )

    def fixed(file, sheet, where, rows):
        """The rows above and below the data, one per (row index, cells); a null index is left out."""
        structs = arr(*[d["ROW"].format(f"cast({i} as bigint)", c) for i, c in rows])
        return f"""
      select file, sheet, r.row_idx as row_idx, r.cells as cells
      from (select {file} as file, {sheet} as sheet, {d['EXPLODE']}({structs}) as r from gf where {where}) x
      where r.row_idx is not null"""

    lost_day = f"not (store = '湾里店' and {d['TO_DAY'].format('ts')} = '2024-01-17')"
    tables["gorders"] = fixed(pos, "'店内订单明细'", "true", [
        (0, arr("'店内订单明细'", null)),
        (1, arr("'门店名称'", null, "store_raw")),
        ("case when store = '湾里店' and week = 0 then null else 2 end", arr("'下单时间'", "declared", null)),
        (3, arr("'制表人'", "'甲'")),
        (5, head),
        (BIG, arr("'合计'", "'-'")),
    ]) + f"""
      union all select {pos}, '店内订单明细', 10 + event_id, {line} from gw where {lost_day}"""
    sheet = "'商品-店内订单明细'"
    tables["gitems"] = fixed(pos, sheet, "not (store = '万荷店' and week = 3)", [
        (0, arr("'商品明细'", null)),
        (4, text("序号", "订单号", "商品名称", "商品中类", "规格", "单价", "数量", "备用")),
    ]) + f"""
      union all select {pos}, {sheet}, 10 + event_id, {arr(cast('l_linenumber'), cast('event_id'),
        "concat('SKU', " + cast('l_partkey') + ")", "case when l_returnflag = 'R' then '' else l_returnflag end",
        "case when l_linestatus = 'F' then 'None' else l_linestatus end", cast('l_suppkey'),
        "case when l_linenumber = 7 then '　' else " + cast('cast(l_quantity as int)') + " end", null)}
        from gw join li on l_orderkey = event_id where not (store = '万荷店' and week = 3)"""
    names = ["订单金额", "菜品优惠", "订单优惠", "平台优惠", "外卖抽佣", "订单支出", "部分退款", "顾客实付", "打包费", "配送费"]
    mods = [5, 4, 3, 2, 8, 9, 30, 40, 6, 7]
    cells = [
        "case when k = 98 then '-' else " + cast("event_id") + " end",
        "case event_type when 'view' then '美团外卖' when 'click' then '淘宝闪购餐饮外卖' else '饿了么' end",
        ts,
        d["TO_DAY"].format("ts"),
        "case when k % 19 <> 18 then " + d["TO_TEXT"].format(d["MIN"].format("k % 5")) + " end",
        f"case when k < 95 then {out} end",
        "case when k < 85 then '已完成' else '已退单' end",
        *[f"case when k % {m} = 0 then '' else {cast('k % ' + str(m))} end" for m in mods],
    ]
    out_file = "concat(short, '平台外卖订单明细', tail)"
    osheet = "'平台外卖订单明细'"
    tables["gtake"] = fixed(out_file, osheet, "true", [
        (0, arr("'门店名称'", "store_raw")),
        ("case when week <> 1 then 1 end", arr("'营业日'", "declared")),
        ("case when week = 2 then 2 end", arr("'下单时间'", "declared")),
        (5, text("外卖订单号", "订单来源", "下单时间", "营业日", "接单时间", "送达时间", "订单状态", *names)),
        (BIG, arr("'-'", "'合计'")),
    ]) + f"""
      union all select {out_file}, {osheet}, 10 + event_id, {arr(*cells)} from gw where {lost_day}"""
    day = d["TO_DAY"].format("ts")
    tables["gvisits"] = f"""
      select distinct concat(case when user_id % 2 = 0 then '桌探数据_' else 'visits_' end, {day}, '.csv') as file,
        'csv' as sheet, cast(0 as bigint) as row_idx, {text('订单号', '就餐人数', '店面', '语音转录', '总体满意度评分')} as cells from gw
      union all select concat(case when user_id % 2 = 0 then '桌探数据_' else 'visits_' end, {day}, '.csv'), 'csv',
        1 + event_id, {arr(cast('event_id'), cast('k % 6 + 1'), 'store', "''", "'5'")} from gw
      union all select distinct concat('other_', {day}, '.csv'), 'csv', cast(0 as bigint), {text('订单号', '其他')} from gw"""
    tables["grid"] = "select * from gorders union all select * from gitems union all select * from gtake union all select * from gvisits"
    return tables


def grid(spark, sf, name: str = "grid"):
    """The grid as a DataFrame; other names give its parts."""
    frames = {"ev": R.events(spark, sf), "li": R.table(spark, sf, "lineitem")}
    for key, text in sql(SPARK).items():
        used = {k: v for k, v in frames.items() if f" {k}" in text}
        for k in used:
            text = _replace_table(text, k)
        frames[key] = spark.sql(text, **used)
    return frames[name]


def _replace_table(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)


def duck() -> dict[str, str]:
    out = dict(sql(DUCK))
    out["li"] = "select * from lineitem"
    return out
