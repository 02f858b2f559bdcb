"""Queries of the raw grid and of ingest validation."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions.cells import cell_at, is_empty_cell, parse_time
from dinefold.operators import validation as V
from dinefold.plans import roles as R
from dinefold.plans.catalog import query
from dinefold.plans.grids import CLOSURES, SCHEMA, duck, grid
from dinefold.plans.out import plain
from dinefold.plans.prelude import oracle
from dinefold.session import stored
from dinefold.sources import config as CFG
from dinefold.sources import grid as G

NUMBER = "regexp_full_match({0}, '[0-9]+')"
EMPTY = "({0} is null or lower(trim({0}, ' 　')) in ('', 'nan', 'none', 'nat'))"

# Headers and data rows of every sheet, in DuckDB.
STEPS = {
    "gkeyed": """
      select *, case when sheet = '平台外卖订单明细' then '外卖订单号' else '订单号' end as key,
        case when sheet = '平台外卖订单明细' then 0 else 1 end as first_row
      from grid where sheet in ('店内订单明细', '商品-店内订单明细', '平台外卖订单明细')""",
    "ghead": """
      select file, sheet, key, first_row, row_idx as header_idx, cells as header from (
        select *, row_number() over (partition by file, sheet order by row_idx) as n from gkeyed
        where row_idx >= first_row and len(list_filter(cells, lambda c: contains(c, key))) > 0) where n = 1""",
    "grows": """
      select g.file, g.sheet, g.row_idx, g.cells, h.header, h.key from gkeyed g join ghead h using (file, sheet)
      where g.row_idx > h.header_idx""",
    "gcell": f"""
      select file, sheet, row_idx, unnest(range(1, len(header) + 1)) as pos,
        unnest(header) as col, unnest(list_transform(range(1, len(header) + 1), lambda i: cells[i])) as v,
        coalesce({NUMBER.format('cells[list_position(header, key)]')}, false) as valid
      from grows""",
    "gstat": f"""
      select file, sheet, pos - 1 as pos, col, bool_or(v is not null) as filled,
        count(*) filter (where valid) as n_valid, count(*) filter (where valid and {EMPTY.format('v')}) as n_empty
      from gcell group by all""",
    "gtop": """
      select file, sheet, row_idx, list_transform(list_filter(cells, lambda c: c is not null and c <> 'nan'), lambda c: trim(c)) as vals
      from gkeyed where sheet <> '商品-店内订单明细' and row_idx >= first_row and row_idx < first_row + 15""",
    "gend": "select file, min(row_idx) as stop from gtop where list_has_any(vals, ['订单号', '外卖订单号']) group by file",
    "gpair": """
      select file, row_idx, k, vals[list_position(vals, k) + 1] as v
      from (select t.*, unnest(['门店名称', '下单时间', '营业日']) as k from gtop t left join gend using (file)
        where stop is null or row_idx < stop)
      where list_position(vals, k) > 0 and list_position(vals, k) < len(vals)""",
    "gmeta": """
      select file, max(v) filter (where k = '门店名称') as store_raw, max(v) filter (where k = '下单时间') as time_text,
        max(v) filter (where k = '营业日') as business_text
      from (select *, row_number() over (partition by file, k order by row_idx) as n from gpair) where n = 1 group by file""",
    "gperiod": r"""
      select file, store_raw, case when contains(store_raw, '万荷') then '万荷店' when contains(store_raw, '保利') then '保利店'
          when store_raw = '' then '未知门店' else store_raw end as store_name,
        coalesce(nullif(regexp_extract(txt, rx, 1), ''), nullif(regexp_extract(file, rx, 1), '')) as period_start,
        coalesce(nullif(regexp_extract(txt, rx, 2), ''), nullif(regexp_extract(file, rx, 2), '')) as period_end
      from (select f.file, coalesce(store_raw, '') as store_raw, '(\d{4}-\d{2}-\d{2}).*?(\d{4}-\d{2}-\d{2})' as rx,
          case when contains(f.file, '外卖') then coalesce(nullif(time_text, ''), business_text) else time_text end as txt
        from (select distinct file from gkeyed) f left join gmeta using (file))""",
    "gspine": """
      select file, store_name, period_start, period_end, cast(unnest(generate_series(
        try_cast(period_start as timestamp), try_cast(period_end as timestamp), interval 1 day)) as date) as day
      from gperiod where try_cast(period_start as date) <= try_cast(period_end as date)""",
    "gdays": """
      select distinct file, try_cast(left(cells[list_position(header, case when sheet = '平台外卖订单明细' then '营业日'
        else '下单时间' end)], 10) as date) as day
      from grows where sheet <> '商品-店内订单明细' and coalesce(regexp_full_match(cells[list_position(header, key)], '[0-9]+'), false)""",
    "gclosed": "select * from (values ('_all_stores', date '2024-02-01'), ('万荷店', date '2024-02-02')) t(store, closed)",
    "ggap": """
      select s.* from gspine s where not exists (select 1 from gdays d where d.file = s.file and d.day = s.day)
        and not exists (select 1 from gclosed c where c.closed = s.day and c.store in ('_all_stores', s.store_name))""",
    "gsheets": """
      select file, sheet from (select distinct file from grid where sheet in ('店内订单明细', '商品-店内订单明细')) f,
        (values ('店内订单明细'), ('商品-店内订单明细')) s(sheet)
      where not exists (select 1 from grid g where g.file = f.file and g.sheet = s.sheet)""",
    "greq": "select * from (values " + ", ".join(
        f"('{sheet}', {i}, '{c}', {str(c in SCHEMA[key]['nullable']).lower()})"
        for sheet, key in ((P.ORDERS_SHEET, "pos_orders"), (P.ITEMS_SHEET, "pos_items"))
        for i, c in enumerate(SCHEMA[key]["required"])
    ) + ") t(sheet, i, col, nullable)",
    "gmiss": """
      select h.file, h.sheet, string_agg(r.col, '、' order by r.i) as cols, count(*) as n from ghead h join greq r using (sheet)
      where not exists (select 1 from gstat s where s.file = h.file and s.sheet = h.sheet and s.col = r.col and s.filled)
        and not (r.col = '门店名称' and exists (select 1 from gperiod p where p.file = h.file and p.store_raw <> ''))
      group by all""",
    "gnull": """
      select s.file, s.sheet, s.col, s.n_empty, r.i as ord from gstat s join greq r using (sheet, col)
      where s.filled and not r.nullable and s.n_empty > 0
      union all select file, sheet, col, n_empty, pos from gstat where sheet = '平台外卖订单明细' and filled and n_empty > 0""",
    "gnull_rn": "select *, row_number() over (partition by file, sheet order by ord) as rn from gnull",
    "gnullmsg": """
      select file, sheet, rn + 1 as ord, 'empty_cells' as code, concat(sheet, '：列「', col, '」有 ', n_empty, ' 行空值（要求每列每条记录均有值）') as message
      from gnull_rn where rn <= 8
      union all select file, sheet, 10, 'more_empty_columns', concat(sheet, '：另有 ', count(*), ' 列存在空值，请全表检查')
      from gnull_rn where rn > 8 group by file, sheet""",
    "gdatemsg": """
      select file, 'no_period' as code, '无法从文件元数据或文件名解析下单日期范围' as message from gperiod where period_start is null
      union all select file, 'bad_range', concat('声明范围 ', period_start, '~', period_end, ' 不是有效日期') from gperiod
        where period_start is not null and (try_cast(period_start as date) is null or try_cast(period_end as date) is null)
      union all select file, 'missing_days', concat('声明范围 ', period_start, '~', period_end, ' 内缺 ', max(n), ' 天订单数据：',
          string_agg(strftime(day, '%Y-%m-%d'), ', ' order by day) filter (where rn <= 15),
          case when max(n) > 15 then ' ...' else '' end, '（非春节/已登记闭店日不可缺日，请重新导出完整 Excel）')
        from (select *, row_number() over (partition by file order by day) as rn, count(*) over (partition by file) as n from ggap)
        group by file, period_start, period_end""",
    "gposfile": """
      select f.file, not exists (select 1 from gsheets s where s.file = f.file) as complete,
        (select count(*) from ghead h where h.file = f.file) = 2 as headed
      from (select distinct file from grid where sheet in ('店内订单明细', '商品-店内订单明细')) f""",
    "gissue": """
      select file, 0 as step, case when sheet = '店内订单明细' then 0 else 1 end as ord, 'missing_sheet' as code,
        concat('缺少工作表「', sheet, '」') as message from gsheets
      union all select file, 1, 0, 'missing_header', '未找到含「订单号」的表头行' from gposfile where complete and not headed
      union all select file, case when sheet = '店内订单明细' then 2 else 3 end, 1, 'missing_columns',
        concat(sheet, '：相对标准缺少 ', n, ' 列：', cols, '（请重新导出包含全部列的 Excel）')
        from gmiss join gposfile using (file) where complete and headed
      union all select file, case when sheet = '店内订单明细' then 2 else 3 end, ord, code, message
        from gnullmsg join gposfile using (file) where complete and headed
      union all select file, 4, 0, code, message from gdatemsg join gposfile using (file) where complete and headed""",
    "gsummary": """
      select f.file, i.n is null as ok, case when complete then store_name else '' end as store_name,
        case when complete then coalesce(period_start, '') else '' end as period_start,
        case when complete then coalesce(period_end, '') else '' end as period_end,
        coalesce(i.n, 0) as n_errors, coalesce(i.errors, '') as errors
      from gposfile f left join gperiod using (file) left join (
        select file, count(*) as n, string_agg(message, chr(10) order by step, ord, message) as errors from gissue group by file) i using (file)""",
}


def goracle(body: str) -> str:
    return oracle(body, **duck(), **STEPS)


def files(spark, sf, sheets=tuple(G.SHEETS)):
    """The grid as a table: the checks read it for the heads and for the columns of its sheets."""
    return stored(grid(spark, sf).filter(F.col("sheet").isin(*sheets)), "grid")


def order_files(spark, sf):
    return files(spark, sf, G.POS_SHEETS)


def headers(spark, sf):
    return G.locate_headers(grid(spark, sf))


def rows(spark, sf):
    g = files(spark, sf)
    return G.data_rows(g, G.locate_headers(g))


@query("grid_locate_header", goracle("select file, sheet, header_idx, array_to_string(header, '|') as header from ghead"))
def grid_locate_header(spark, sf):
    return headers(spark, sf).withColumn("header", F.array_join("header", "|"))


TABLE = {"订单号": "order_no", "下单时间": "order_time", "会员手机号": "phone", "商品名称": "item", "外卖订单号": "takeaway_id"}


@query(
    "grid_to_table",
    goracle(
        "select file, sheet, row_idx, "
        + ", ".join(f"case when list_position(header, '{h}') > 0 then cells[list_position(header, '{h}')] end as {n}" for h, n in TABLE.items())
        + " from grows"
    ),
)
def grid_to_table(spark, sf):
    return G.grid_to_table(rows(spark, sf), TABLE)


@query("drop_all_null_columns", goracle('select file, sheet, cast(pos as int) as pos, col as "column" from gstat where filled'))
def drop_all_null_columns(spark, sf):
    g = files(spark, sf)
    headers = G.locate_headers(g)
    return G.drop_all_null_columns(G.data_rows(g, headers), headers)


@query("sheet_metadata", goracle("select f.file, store_raw, time_text, business_text from (select distinct file from gtop) f left join gmeta using (file)"))
def sheet_metadata(spark, sf):
    return G.sheet_metadata(grid(spark, sf))


@query("required_sheets", goracle("select file, sheet from gsheets"))
def required_sheets(spark, sf):
    return G.required_sheets(grid(spark, sf))


@query(
    "detect_file_kind",
    goracle(
        """select file, case when contains(file, '店内订单明细') or (bool_or(sheet = '店内订单明细') and bool_or(sheet = '商品-店内订单明细')) then 'pos'
          when contains(file, '桌探数据') or bool_or(row_idx = 0 and list_has_all(cells, ['订单号', '就餐人数', '语音转录', '总体满意度评分'])) then 'visits'
          when bool_or(sheet = '平台外卖订单明细') or bool_or(row_idx < 20 and list_contains(cells, '外卖订单号')) then 'takeaway'
          else 'unknown' end as kind from grid group by file"""
    ),
)
def detect_file_kind(spark, sf):
    return G.detect_file_kind(grid(spark, sf))


@query("valid_id_rows", goracle(f"select file, sheet, row_idx from grows where {NUMBER.format('cells[list_position(header, key)]')}"))
def valid_id_rows(spark, sf):
    return V.valid_id_rows(rows(spark, sf)).select("file", "sheet", "row_idx")


@query("missing_columns", goracle("select file, sheet, replace(cols, '、', ',') as missing from gmiss"))
def missing_columns(spark, sf):
    out = V.missing_columns(V.sheet_report(files(spark, sf)), SCHEMA)
    return out.select("file", "sheet", F.array_join("missing", ",").alias("missing"))


@query("null_cells_by_column", goracle('select file, sheet, col as "column", n_empty from gnull'))
def null_cells_by_column(spark, sf):
    return V.null_cells_by_column(V.sheet_report(files(spark, sf)), SCHEMA).drop("check_order")


@query("truncate_issues", goracle("select file, sheet, message from gnullmsg"))
def truncate_issues(spark, sf):
    return V.truncate_issues(V.sheet_report(files(spark, sf)), SCHEMA).select("file", "sheet", "message")


@query(
    "is_empty_cell",
    goracle(f"select file, sheet, count(*) as n_cells, count(*) filter (where {EMPTY.format('v')}) as n_empty from gcell group by all"),
)
def is_empty_cell_query(spark, sf):
    at = F.transform(F.sequence(F.lit(0), F.size("header") - 1), lambda i: F.get(F.col("cells"), i))
    cells = rows(spark, sf).select("file", "sheet", F.explode(at).alias("v"))
    return cells.groupBy("file", "sheet").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(is_empty_cell(F.col("v"))).alias("n_empty"))


def periods(spark, sf):
    meta = G.sheet_metadata(grid(spark, sf))
    other = F.col("file").contains("外卖")
    return G.file_period(meta.filter(~other)).unionByName(G.file_period(meta.filter(other), takeaway=True))


@query("normalize_store", goracle("select file, store_raw, store_name from gperiod"))
def normalize_store(spark, sf):
    return periods(spark, sf).select("file", "store_raw", "store_name")


@query("parse_date_range", goracle("select file, period_start, period_end from gperiod"))
def parse_date_range(spark, sf):
    return periods(spark, sf).select("file", "period_start", "period_end")


@query("date_spine", goracle("select file, strftime(day, '%Y-%m-%d') as day from gspine"))
def date_spine(spark, sf):
    return plain(V.date_spine(periods(spark, sf)).select("file", "day"))


@query("date_coverage_gaps", goracle("select file, store_name, strftime(day, '%Y-%m-%d') as day from ggap"))
def date_coverage_gaps(spark, sf):
    column = F.when(F.col("sheet") == P.TAKEAWAY_SHEET, F.get(F.col("cells"), F.lit(3))).otherwise(
        cell_at(F.col("cells"), F.col("header"), P.ORDER_TIME_COLUMN)
    )
    r = V.valid_id_rows(rows(spark, sf)).filter(F.col("sheet") != P.ITEMS_SHEET)
    days = r.select("file", parse_time(column).cast("date").alias("day"))
    gaps = V.date_coverage_gaps(periods(spark, sf), days, V.closures_frame(spark, CLOSURES))
    return plain(gaps.select("file", "store_name", "day"))


SUMMARY = "file, ok, store_name, period_start, period_end, n_errors, errors"


@query("validate_pos", goracle(f"select {SUMMARY} from gsummary"))
def validate_pos(spark, sf):
    return V.validate_pos(order_files(spark, sf), SCHEMA, V.closures_frame(spark, CLOSURES))


@query(
    "validate_takeaway",
    goracle(
        """select file, i.n is null as ok, store_name, coalesce(period_start, '') as period_start, coalesce(period_end, '') as period_end,
          coalesce(i.n, 0) as n_errors, coalesce(errors, '') as errors
        from gperiod p left join (select file, count(*) as n, string_agg(message, chr(10) order by step, ord, message) as errors from (
            select file, 2 as step, ord, message from gnullmsg where sheet = '平台外卖订单明细'
            union all select file, 4, 0, message from gdatemsg) group by file) i using (file)
        where contains(file, '外卖')"""
    ),
)
def validate_takeaway(spark, sf):
    """Without a column list: all columns are checked; strict dates on."""
    return V.validate_takeaway(files(spark, sf, [P.TAKEAWAY_SHEET]), {}, V.closures_frame(spark, CLOSURES), strict_dates=True)


@query("validate_many", goracle("select file, cast(step as int) as step, cast(ord as int) as ord, concat('[', file, '] ', message) as error from gissue"))
def validate_many(spark, sf):
    return V.validate_many(V.pos_files(order_files(spark, sf), SCHEMA, V.closures_frame(spark, CLOSURES)))


@query(
    "fail_gate",
    goracle(
        """select file, concat(file, ': 入库校验未通过，请修正 Excel 后重新提交：', chr(10), '  - ', replace(errors, chr(10), concat(chr(10), '  - '))) as text
        from gsummary where not ok"""
    ),
)
def fail_gate(spark, sf):
    """The gate raises on this data; the registered query is the text it raises with."""
    return V.gate_text(V.validate_pos(order_files(spark, sf), SCHEMA, V.closures_frame(spark, CLOSURES)))


# Files whose store and period are known, and the rows that the precheck counts.
STEPS["gknown"] = """select p.* from gperiod p left join gposfile f using (file) where coalesce(complete, true)"""
STEPS["gvalid"] = """
  select file, sheet, cells[list_position(header, '订单金额')] as amount, trim(cells[list_position(header, '订单来源')], ' 　') as platform,
    trim(cells[list_position(header, '订单状态')], ' 　') as status
  from grows where sheet <> '商品-店内订单明细' and coalesce(regexp_full_match(cells[list_position(header, key)], '[0-9]+'), false)"""
STEPS["gtable"] = """
  select g.file, g.row_idx, g.cells[list_position(h.cells, '店面')] as store from gvisits g join gvisits h
    on h.file = g.file and h.row_idx = 0 and list_has_all(h.cells, ['订单号', '就餐人数', '语音转录', '总体满意度评分'])"""


@query(
    "precheck_levels",
    goracle(
        rf"""select file, 'Error' as level, code, message as detail from gissue
        union all select file, 'Error', code, message from gnullmsg where sheet = '平台外卖订单明细'
        union all select file, 'Error', code, message from gdatemsg where contains(file, '外卖')
        union all select file, 'Warning', 'period_differs_from_name', concat(period_start, '~', period_end)
          from gknown where period_start <> regexp_extract(file, '(\d{{4}}-\d{{2}}-\d{{2}})', 1)
            or period_end <> regexp_extract(file, '~(\d{{4}}-\d{{2}}-\d{{2}})', 1)
        union all select file, 'Warning', 'unknown_store', store_name from gknown where store_name = '未知门店'
        union all select file, 'Info', 'store', store_name from gknown
        union all select file, 'Info', 'period', concat(period_start, '~', period_end) from gknown where period_start is not null
        union all select file, 'Info', 'orders', cast(count(*) as varchar) from gvalid group by file
        union all select file, 'Warning', 'empty_amounts', cast(count(*) as varchar) from gvalid where {EMPTY.format('amount')} group by file
        union all select file, 'Warning', 'returns', cast(count(*) as varchar) from gvalid where status = '已退单' group by file
        union all select distinct file, 'Info', 'platform', platform from gvalid where sheet = '平台外卖订单明细'
        union all select file, 'Info', 'visits', cast(count(*) filter (where row_idx > 0) as varchar) from gtable group by file
        union all select distinct file, 'Info', 'store', store from gtable where row_idx > 0
        union all select file, 'Warning', 'mixed_stores', cast(count(distinct store) as varchar) from gtable where row_idx > 0
          group by file having count(distinct store) > 1
        union all select distinct file, 'Warning', 'unknown_file', file from gvisits where starts_with(file, 'other_')"""
    ),
)
def precheck_levels(spark, sf):
    """All four kinds of files."""
    g, closures = stored(grid(spark, sf), "grid"), V.closures_frame(spark, CLOSURES)
    heads = V.stored_heads(g)
    checked = [V.pos_files(g, SCHEMA, closures, heads), V.takeaway_files(g, {}, closures, strict_dates=True, heads=heads)]
    lines = [*map(V.precheck_levels, checked), V.precheck_orders(g, heads), V.precheck_visits(g)]
    return functools.reduce(lambda a, b: a.unionByName(b), lines)


# --- configuration documents, one per event user --------------------------------

DOC_SQL = """
  select 'user-' || cast(user_id as varchar) as file, unnest(['_all_stores', store]) as store,
    strftime(ts, '%Y-%m-%d') as closed_date, k from ev"""


def documents(spark, sf):
    """A closure document per user: days with k below 20 closed everywhere, below 40 in the store."""
    e = R.events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    per_user = e.groupBy("user_id", "store").agg(
        F.collect_set(F.when(F.col("k") < 20, F.col("day"))).alias("a"),
        F.collect_set(F.when((F.col("k") >= 20) & (F.col("k") < 40), F.col("day"))).alias("b"),
    )
    entries = F.map_from_arrays(
        F.array(F.lit("_comment"), F.lit("note"), F.lit(P.ALL_STORES), F.col("store")),
        F.array(F.lit('"text"'), F.lit('{"x": 1}'), F.to_json("a"), F.to_json("b")),
    )
    pairs = F.transform(F.map_entries(entries), lambda x: F.concat(F.lit('"'), x["key"], F.lit('": '), x["value"]))
    return per_user.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"),
        F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("text"),
    )


CALENDAR_SQL = """select distinct 'user-' || cast(user_id as varchar) as file,
    case when k < 20 then '_all_stores' else store end as store, strftime(ts, '%Y-%m-%d') as closed_date from ev where k < 40"""


@query("closure_calendar", oracle(CALENDAR_SQL))
def closure_calendar(spark, sf):
    return CFG.closure_calendar(documents(spark, sf))


@query(
    "allowed_missing_dates",
    oracle(
        """select distinct 'user-' || cast(user_id as varchar) as file, store, strftime(ts, '%Y-%m-%d') as closed_date
        from ev where k < 40"""
    ),
)
def allowed_missing_dates(spark, sf):
    stores = R.events(spark, sf).select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"), "store").distinct()
    return CFG.allowed_missing_dates(CFG.closure_calendar(documents(spark, sf)), stores)


@query(
    "sheet_schema",
    oracle(
        """select 'user-' || cast(user_id as varchar) as file, 'pos_orders' as sheet, event_type as "column",
          bool_or(k < 70) as required, bool_or(k >= 50) as nullable from ev group by all"""
    ),
)
def sheet_schema(spark, sf):
    """A schema document per user: its event types as columns, marked by k."""
    docs = R.events(spark, sf).groupBy("user_id").agg(
        F.collect_set(F.when(F.col("k") < 70, F.col("event_type"))).alias("required"),
        F.collect_set(F.when(F.col("k") >= 50, F.col("event_type"))).alias("nullable"),
    )
    text = F.concat(
        F.lit('{"_note": {"required": ["x"]}, "pos_orders": '), F.to_json(F.struct("required", "nullable")), F.lit("}")
    )
    return CFG.sheet_schema(docs.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file"), text.alias("text")))
