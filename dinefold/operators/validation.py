"""Completeness checks of incoming files, all files in one pass.

Issues are (step, ord, code, message); `step` and `ord` give the order in which the messages of
a file are listed. A file has a bounded number of issues: two per sheet
list, one per sheet for missing columns, nine for empty cells and one for dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions.business import normalize_store, range_end, range_start
from dinefold.functions.cells import cell_at, is_digit_id, is_empty_cell, parse_time, strip
from dinefold.operators.periods import period_bounds
from dinefold.session import stored
from dinefold.sources import grid as G

SHEET_KEY = {P.ORDERS_SHEET: "pos_orders", P.ITEMS_SHEET: "pos_items", P.TAKEAWAY_SHEET: "takeaway"}
STEP = {P.ORDERS_SHEET: 2, P.ITEMS_SHEET: 3, P.TAKEAWAY_SHEET: 2}
DATE_STEP = 4
MAX_COLUMN_ISSUES = 8
MAX_LISTED_DAYS = 15

# Message formats.
MSG_SHEET = "缺少工作表「%s」"
MSG_HEADER = "未找到含「%s」的表头行"
MSG_ID_COLUMN = "%s：缺少必要列「%s」"
MSG_NO_ROWS = "%s：无有效数据行"
MSG_COLUMNS = "%s：相对标准缺少 %d 列：%s（请重新导出包含全部列的 Excel）"
MSG_NULLS = "%s：列「%s」有 %d 行空值（要求每列每条记录均有值）"
MSG_MORE_NULLS = "%s：另有 %d 列存在空值，请全表检查"
MSG_NO_PERIOD = "无法从文件元数据或文件名解析下单日期范围"
MSG_NO_TIME = "店内订单明细缺少「下单时间」列，无法校验日期完整性"
MSG_GAPS = "声明范围 %s~%s 内缺 %d 天订单数据：%s%s（非春节/已登记闭店日不可缺日，请重新导出完整 Excel）"
MSG_BAD_RANGE = "声明范围 %s~%s 不是有效日期"
MSG_GATE = "入库校验未通过，请修正 Excel 后重新提交："


_ISSUES = "array<struct<step:int,ord:int,code:string,message:string>>"


def _issue(step, ord_, code: str, message: Column) -> Column:
    as_int = lambda x: F.lit(x).cast("int")
    return F.struct(as_int(step).alias("step"), as_int(ord_).alias("ord"), F.lit(code).alias("code"), message.alias("message"))


def _none() -> Column:
    return F.array().cast(_ISSUES)


def _one_if(cond: Column, step, ord_, code: str, message: Column) -> Column:
    """A list with one issue where the condition holds, else an empty list."""
    return F.when(cond, F.array(_issue(step, ord_, code, message)).cast(_ISSUES)).otherwise(_none())


def _step() -> Column:
    out = F.lit(0)
    for sheet, n in STEP.items():
        out = F.when(F.col("sheet") == sheet, n).otherwise(out)
    return out


def _lookup(schema: dict, part: str) -> Column:
    """Configured column list of the row's sheet, empty when there is none."""
    out = F.array().cast("array<string>")
    for sheet, key in SHEET_KEY.items():
        names = schema.get(key, {}).get(part) or []
        if names:
            out = F.when(F.col("sheet") == sheet, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


def _id_cell() -> Column:
    pos = F.array_position("header", G.id_column())
    return F.when(pos > 0, F.get(F.col("cells"), (pos - 1).cast("int")))


def valid_id_rows(rows: DataFrame) -> DataFrame:
    """Data rows whose id is digits only."""
    return rows.filter(is_digit_id(_id_cell()))


def _positions(heads: DataFrame) -> DataFrame:
    """Where the cells that matter stand, as numbers, so that rows don't carry the header and search it."""
    at = lambda name: F.nullif(F.array_position("header", name), F.lit(0)).cast("int") - 1
    return heads.filter("header_idx is not null").select(
        "file", "sheet", "header_idx", F.size("header").alias("width"), at(G.id_column()).alias("id_pos"),
        at(P.ORDER_TIME_COLUMN).alias("time_pos"), at(P.BUSINESS_DATE_COLUMN).alias("date_pos"),
    )


ABSENT, EMPTY, FULL = "0", "1", "2"


def column_stats(rows: DataFrame) -> DataFrame:
    """Per column position: any value at all, valid rows, non-empty cells and days of valid rows.

    Rows carry the numbers of `_positions`. A row becomes one text, its pattern: a character per cell that says
    null, empty or full. Equal patterns are counted, on the map side first, and only the distinct patterns of a sheet
    are taken apart into positions; exports fill the same columns in nearly all rows. Days belong to the
    two columns with dates and are bounded by the calendar.
    """
    cells = F.slice("cells", F.lit(1), F.col("width"))
    kind = F.transform(cells, lambda v: F.when(v.isNull(), ABSENT).when(is_empty_cell(v), EMPTY).otherwise(FULL))
    valid = is_digit_id(F.get(F.col("cells"), F.col("id_pos")))

    def day(position: str) -> Column:
        inside = F.col(position) < F.col("width")
        return F.when(valid & inside, parse_time(F.get(F.col("cells"), F.col(position))).cast("date"))

    sheet = ["file", "sheet", "time_pos", "date_pos", "pattern", "valid"]
    marked = rows.select(
        "file", "sheet", "time_pos", "date_pos", F.array_join(kind, "").alias("pattern"), valid.alias("valid"),
        day("time_pos").alias("time_day"), day("date_pos").alias("date_day"),
    )
    per_day = marked.groupBy(*sheet, "time_day", "date_day").agg(F.count(F.lit(1)).alias("n"))
    patterns = per_day.groupBy(*sheet).agg(
        F.sum("n").alias("n"), F.collect_set("time_day").alias("time_days"), F.collect_set("date_day").alias("date_days")
    )
    # Outer, and filtered after it: a filter on patterns would be moved below the counts, and the pattern of each row be made twice.
    spread = patterns.select("*", F.posexplode_outer(F.split("pattern", "(?<=.)(?=.)")).alias("pos", "kind")).filter("kind != ''")
    days = F.when(F.col("pos") == F.col("time_pos"), F.col("time_days")).when(F.col("pos") == F.col("date_pos"), F.col("date_days"))
    dated = spread.select("file", "sheet", "pos", "kind", "valid", "n", F.posexplode_outer(days).alias("i", "day"))
    # A pattern counts once, on the first of its days.
    n = F.when(F.col("valid") & (F.coalesce("i", F.lit(0)) == 0), F.col("n")).otherwise(0)
    return dated.groupBy("file", "sheet", "pos").agg(
        F.max(F.col("kind") != ABSENT).alias("filled"),
        F.sum(n).alias("n_valid"),
        F.sum(F.when(F.col("kind") == FULL, n).otherwise(0)).alias("n_full"),
        # Bounded by the calendar.
        F.collect_set("day").alias("days"),
    )


def sheet_columns(heads: DataFrame, stats: DataFrame) -> DataFrame:
    """Sheets with their metadata and the statistics of their columns as a list.

    Only columns with a value in some row count. The store written above the header becomes a
    column of both order sheets. A sheet without rows below its header has no columns.
    """
    lists = stats.groupBy("file", "sheet").agg(
        # Every valid row has an id cell, so the id column has the full count.
        F.max("n_valid").alias("n_valid"),
        # Bounded by the width of a sheet.
        F.array_sort(F.collect_list(F.when(F.col("filled"), F.struct("pos", "n_full", "days")))).alias("found"),
    )
    cols_t = "array<struct<pos:int,column:string,n_empty:bigint,days:array<date>>>"
    given = F.col("given")
    named = F.transform(
        "found",
        lambda c: F.struct(
            c["pos"].alias("pos"),
            F.get(F.col("header"), c["pos"]).alias("column"),
            (F.col("n_valid") - c["n_full"]).alias("n_empty"),
            c["days"].alias("days"),
        ),
    )
    out = (
        heads.join(lists, ["file", "sheet"], "left")
        .withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("bigint")))
        .withColumn("cols", F.coalesce(named.cast(cols_t), F.array().cast(cols_t)))
        .drop("found")
        .withColumn("given", (F.max(F.coalesce("store_raw", F.lit(""))).over(W.partitionBy("file")) != "")
                    & (F.col("sheet") != P.TAKEAWAY_SHEET))
        .withColumn("cols", F.filter("cols", lambda c: ~(given & c["column"].eqNullSafe(P.STORE_COLUMN))))
    )
    names = F.transform("cols", lambda c: c["column"])
    return out.withColumn(
        "actual", F.when(given, F.array_append(names, F.lit(P.STORE_COLUMN))).otherwise(names)
    ).withColumn("has_id", F.array_contains("actual", G.id_column()))


def stored_heads(grid: DataFrame) -> DataFrame:
    """Heads of the sheets, found once; rows are then told by a small table where their cells stand."""
    return stored(G.sheet_heads(grid), "heads")


def sheet_report(grid: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Everything the checks need, one row per sheet."""
    heads = stored_heads(grid) if heads is None else heads
    return sheet_columns(G.with_metadata(heads), column_stats(G.data_rows(grid, _positions(heads))))


def _missing(schema: dict) -> Column:
    return F.array_except(_lookup(schema, "required"), F.col("actual"))


def missing_columns(sheets: DataFrame, schema: dict) -> DataFrame:
    """Required columns a sheet lacks, in the order of the requirement."""
    found = sheets.filter("header_idx is not null")
    return found.withColumn("missing", _missing(schema)).filter(F.size("missing") > 0)


def _null_cells(schema: dict) -> Column:
    """Checked columns with empty cells, in check order."""
    required, nullable = _lookup(schema, "required"), _lookup(schema, "nullable")
    listed = F.size(required) > 0

    def checked(c):
        name = c["column"]
        named = name.isNotNull() & (F.trim(name) != "") & (name != "nan")
        wanted = F.when(listed, F.array_contains(required, name)).otherwise(named)
        return wanted & ~F.coalesce(F.array_contains(nullable, name), F.lit(False)) & (c["n_empty"] > 0)

    def entry(c):
        order = F.when(listed, F.array_position(required, c["column"])).otherwise(c["pos"].cast("bigint") + 1)
        return F.struct(order.alias("check_order"), c["column"].alias("column"), c["n_empty"].alias("n_empty"))

    return F.array_sort(F.transform(F.filter("cols", checked), entry))


def null_cells_by_column(sheets: DataFrame, schema: dict) -> DataFrame:
    return sheets.select("file", "sheet", F.inline(_null_cells(schema)))


def _null_issues(schema: dict) -> Column:
    """At most eight column issues per sheet, then one line for the rest."""
    nulls = _null_cells(schema)
    step = _step()
    first = F.transform(
        F.slice(nulls, 1, MAX_COLUMN_ISSUES),
        lambda c, i: _issue(step, i + 2, "empty_cells", F.format_string(MSG_NULLS, F.col("sheet"), c["column"], c["n_empty"])),
    ).cast(_ISSUES)
    more = F.size(nulls) - MAX_COLUMN_ISSUES
    return F.concat(
        first,
        _one_if(more > 0, step, MAX_COLUMN_ISSUES + 2, "more_empty_columns", F.format_string(MSG_MORE_NULLS, F.col("sheet"), more)),
    )


def truncate_issues(sheets: DataFrame, schema: dict) -> DataFrame:
    return sheets.select("file", "sheet", F.inline(_null_issues(schema)))


def _column_issues(schema: dict) -> Column:
    """Missing id, no valid rows, missing columns, empty cells of one sheet."""
    sheet, missing, step = F.col("sheet"), _missing(schema), _step()
    no_id = F.array(_issue(step, 0, "missing_id_column", F.format_string(MSG_ID_COLUMN, sheet, G.id_column()))).cast(_ISSUES)
    no_rows = F.array(_issue(step, 0, "no_valid_rows", F.format_string(MSG_NO_ROWS, sheet))).cast(_ISSUES)
    lacking = _one_if(
        F.size(missing) > 0, step, 1, "missing_columns",
        F.format_string(MSG_COLUMNS, sheet, F.size(missing), F.array_join(missing, "、")),
    )
    return (
        F.when(~F.col("has_id"), no_id)
        .when(F.col("n_valid") == 0, no_rows)
        .otherwise(F.concat(lacking, _null_issues(schema)))
    )


def _days(*columns: str) -> Column:
    """Days of the first of the given columns that the sheet has; null without one."""
    out = F.lit(None).cast("array<date>")
    for name in reversed(columns):
        found = F.filter("cols", lambda c: c["column"].eqNullSafe(name))
        out = F.when(F.size(found) > 0, F.get(found, F.lit(0))["days"]).otherwise(out)
    return out


def date_spine(periods: DataFrame) -> DataFrame:
    """Every day from period_start to period_end; none when the start is later."""
    start, end = F.col("period_start").try_cast("date"), F.col("period_end").try_cast("date")
    return periods.filter(start <= end).withColumn("day", F.explode(F.sequence(start, end)))


def _open_days(days: DataFrame, closures: DataFrame) -> DataFrame:
    """days (store_name, day, ...) without those on which the store, or every store, was closed."""
    closed = closures.select(F.col("store").alias("store_name"), F.col("closed_date").try_cast("date").alias("day"))
    everywhere = closed.filter(F.col("store_name") == P.ALL_STORES).select("day")
    return days.join(everywhere, "day", "left_anti").join(closed, ["store_name", "day"], "left_anti")


def date_coverage_gaps(periods: DataFrame, actual: DataFrame, closures: DataFrame) -> DataFrame:
    """Declared days without an order or an allowed closure.

    periods (file, store_name, period_start, period_end), actual (file, day),
    closures (store, closed_date as text).
    """
    missing = date_spine(periods).join(actual.select("file", "day").distinct(), ["file", "day"], "left_anti")
    return _open_days(missing, closures)


def _date_issues() -> Column:
    """No period, a period that is no date, or days without orders."""
    start, end = F.col("period_start"), F.col("period_end")
    first, last = start.try_cast("date"), end.try_cast("date")
    none = F.array().cast("array<date>")
    spine = F.when(first <= last, F.sequence(first, last)).otherwise(none)
    gaps = F.array_except(F.array_except(spine, F.col("days")), F.coalesce(F.col("closed"), none))
    listed = F.array_join(F.transform(F.slice(gaps, 1, MAX_LISTED_DAYS), lambda d: F.date_format(d, "yyyy-MM-dd")), ", ")
    more = F.when(F.size(gaps) > MAX_LISTED_DAYS, " ...").otherwise("")
    return (
        F.when(start.isNull() | end.isNull(), _one_if(F.lit(True), DATE_STEP, 0, "no_period", F.lit(MSG_NO_PERIOD)))
        .when(
            first.isNull() | last.isNull(),
            _one_if(F.lit(True), DATE_STEP, 0, "bad_range", F.format_string(MSG_BAD_RANGE, start, end)),
        )
        .otherwise(
            _one_if(
                F.size(gaps) > 0, DATE_STEP, 0, "missing_days",
                F.format_string(MSG_GAPS, start, end, F.size(gaps), listed, more),
            )
        )
    )


def with_closures(files: DataFrame, closures: DataFrame) -> DataFrame:
    """Add the days the file's store may miss; at most one list per store."""
    day = F.col("closed_date").try_cast("date")
    own = closures.filter(F.col("store") != P.ALL_STORES).groupBy(F.col("store").alias("store_name")).agg(
        F.collect_set(day).alias("own")
    )
    everywhere = closures.filter(F.col("store") == P.ALL_STORES).agg(F.collect_set(day)).scalar()
    none = F.array().cast("array<date>")
    return (
        files.join(own, "store_name", "left")
        .withColumn("closed", F.array_union(F.coalesce("own", none), F.coalesce(everywhere, none)))
        .drop("own")
    )


def closures_frame(spark: SparkSession, closures: dict[str, list[str]]) -> DataFrame:
    rows = [(store, day) for store, days in closures.items() for day in days]
    return spark.createDataFrame(rows, "store string, closed_date string")


def summary(files: DataFrame) -> DataFrame:
    """One row per file; its messages in order, one per line."""
    blank = F.lit("")
    return files.select(
        "file",
        (F.size("issues") == 0).alias("ok"),
        F.coalesce("store_name", blank).alias("store_name"),
        F.coalesce("period_start", blank).alias("period_start"),
        F.coalesce("period_end", blank).alias("period_end"),
        F.size("issues").cast("bigint").alias("n_errors"),
        F.array_join(F.transform("issues", lambda x: x["message"]), "\n").alias("errors"),
    )


def issue_rows(files: DataFrame) -> DataFrame:
    return files.select("file", F.inline("issues"))


def _of_sheets(df: DataFrame | None, *sheets: str) -> DataFrame | None:
    return None if df is None else df.filter(F.col("sheet").isin(*sheets))


def pos_files(grid: DataFrame, schema: dict, closures: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One row per order file: store, period and its issues as a list.

    The grid is read for the heads of the sheets, unless they are given, and for the column statistics; everything
    after that works on one row per sheet.
    """
    sheets = sheet_report(_of_sheets(grid, *G.POS_SHEETS), _of_sheets(heads, *G.POS_SHEETS))
    sheets = sheets.withColumn("column_issues", _column_issues(schema)).withColumn("days", _days(P.ORDER_TIME_COLUMN))
    facts = F.struct("header_idx", "store_raw", "time_text", "has_id", "days", "column_issues")
    pick = lambda s: F.max(F.when(F.col("sheet") == s, F.col("f")))
    files = (
        sheets.select("file", "sheet", facts.alias("f"))
        .groupBy("file")
        .agg(pick(P.ORDERS_SHEET).alias("o"), pick(P.ITEMS_SHEET).alias("i"))
    )
    orders, items = F.col("o"), F.col("i")
    files = files.withColumns({"store_raw": F.col("o.store_raw"), "time_text": F.col("o.time_text"), "business_text": F.lit(None).cast("string")})
    files = with_closures(G.file_period(files), closures).withColumn("days", F.col("o.days"))
    absent = F.concat(
        _one_if(orders.isNull(), 0, 0, "missing_sheet", F.lit(MSG_SHEET % P.ORDERS_SHEET)),
        _one_if(items.isNull(), 0, 1, "missing_sheet", F.lit(MSG_SHEET % P.ITEMS_SHEET)),
    )
    headless = F.col("o.header_idx").isNull() | F.col("i.header_idx").isNull()
    header = _one_if(F.lit(True), 1, 0, "missing_header", F.lit(MSG_HEADER % P.POS_ID))
    # Without an id column there is no valid row whose date could be checked.
    dates = F.when(~F.col("o.has_id"), _none()).when(
        F.col("days").isNull(), _one_if(F.lit(True), DATE_STEP, 0, "missing_time_column", F.lit(MSG_NO_TIME))
    ).otherwise(_date_issues())
    issues = (
        F.when(F.size(absent) > 0, absent)
        .when(headless, header)
        .otherwise(F.concat("o.column_issues", "i.column_issues", dates))
    )
    complete = orders.isNotNull() & items.isNotNull()
    out = files.withColumn("issues", issues)
    for c in ("store_name", "period_start", "period_end"):
        out = out.withColumn(c, F.when(complete, F.col(c)))
    return out.select("file", "store_name", "period_start", "period_end", "issues")


def validate_pos(grid: DataFrame, schema: dict, closures: DataFrame) -> DataFrame:
    return summary(pos_files(grid, schema, closures))


def takeaway_files(
    grid: DataFrame, schema: dict, closures: DataFrame, strict_dates: bool = False, heads: DataFrame | None = None
) -> DataFrame:
    files = sheet_report(_of_sheets(grid, P.TAKEAWAY_SHEET), _of_sheets(heads, P.TAKEAWAY_SHEET))
    files = files.withColumn("column_issues", _column_issues(schema)).withColumn(
        "days", _days(P.BUSINESS_DATE_COLUMN, P.ORDER_TIME_COLUMN)
    )
    files = with_closures(G.file_period(files, takeaway=True), closures)
    header = _one_if(F.lit(True), 1, 0, "missing_header", F.lit(MSG_HEADER % P.TAKEAWAY_ID))
    # Without a date column or a valid row the date check is left out.
    dated = F.lit(strict_dates) & F.col("days").isNotNull() & (F.col("n_valid") > 0)
    dates = F.when(dated, _date_issues()).otherwise(_none())
    issues = F.when(F.col("header_idx").isNull(), header).otherwise(F.concat("column_issues", dates))
    return files.select("file", "store_name", "period_start", "period_end", issues.alias("issues"))


def validate_takeaway(grid: DataFrame, schema: dict, closures: DataFrame, strict_dates: bool = False) -> DataFrame:
    return summary(takeaway_files(grid, schema, closures, strict_dates))


def validate_many(files: DataFrame) -> DataFrame:
    """All messages of all files, prefixed with their file."""
    return issue_rows(files).select(
        "file", "step", "ord", F.concat(F.lit("["), "file", F.lit("] "), "message").alias("error")
    )


class ValidationFailed(Exception):
    """Raised by the gate; `issues` holds every issue as a DataFrame."""

    def __init__(self, text: str, issues: DataFrame):
        super().__init__(text)
        self.issues = issues


def gate_text(report: DataFrame) -> DataFrame:
    """Per failed file the text shown to the user."""
    return report.filter(~F.col("ok")).select(
        "file",
        F.concat("file", F.lit(f": {MSG_GATE}\n  - "), F.replace("errors", F.lit("\n"), F.lit("\n  - "))).alias("text"),
    )


def fail_gate(report: DataFrame, sink: str | None = None) -> None:
    """Stop the load when any file failed.

    The message says how many files failed and with how many issues; the texts of all of them are in
    the exception's `issues` and, with a sink, in a table written there, which is empty when no file failed.
    No text comes to the driver.
    """
    failed = gate_text(report)
    counts = [F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n  - ")) - 1).alias("issues")]
    if sink is None:
        seen = failed.agg(*counts).first().asDict()
    else:
        # Counted while they are written: the checks run once.
        gate = Observation()
        failed.observe(gate, *counts).write.mode("overwrite").parquet(sink)
        seen, failed = gate.get, report.sparkSession.read.schema(failed.schema).parquet(sink)
    if not seen.get("files"):
        return
    where = f": {sink}" if sink else ""
    raise ValidationFailed(f"{MSG_GATE} ({seen['files']} files, {seen['issues']} issues){where}", failed)


def precheck_levels(files: DataFrame) -> DataFrame:
    """Error, Warning and Info lines of checked files; `precheck_orders` and `precheck_visits` add those that need the rows."""

    def line(level, code, detail):
        return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), detail.alias("detail"))

    known = F.col("store_name").isNotNull()
    span = F.concat_ws("~", "period_start", "period_end")
    renamed = (range_start(F.col("file")) != F.col("period_start")) | (range_end(F.col("file")) != F.col("period_end"))
    facts = F.array(
        F.when(known & (F.col("store_name") == P.STORE_UNKNOWN), line("Warning", "unknown_store", F.col("store_name"))),
        F.when(known & renamed, line("Warning", "period_differs_from_name", span)),
        F.when(known, line("Info", "store", F.col("store_name"))),
        F.when(known & F.col("period_start").isNotNull(), line("Info", "period", span)),
    )
    errors = F.transform("issues", lambda x: F.struct(F.lit("Error").alias("level"), x["code"].alias("code"), x["message"].alias("detail")))
    kind = "array<struct<level:string,code:string,detail:string>>"
    return files.select("file", F.inline(F.concat(errors.cast(kind), F.array_compact(facts).cast(kind))))


def _line(level: str, code: str, detail: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def _lines(facts: DataFrame, *lines: Column) -> DataFrame:
    kind = "array<struct<level:string,code:string,detail:string>>"
    return facts.select("file", F.inline(F.array_compact(F.array(*lines)).cast(kind)))


def precheck_orders(grid: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Lines from the rows of order and takeaway sheets: orders, empty amounts, returns and platforms.

    Rows are counted per file, sheet and platform, on the map side first; totals and platforms both come from those counts.
    """
    sheets = _of_sheets(grid, P.ORDERS_SHEET, P.TAKEAWAY_SHEET)
    heads = stored_heads(sheets) if heads is None else _of_sheets(heads, P.ORDERS_SHEET, P.TAKEAWAY_SHEET)
    rows = valid_id_rows(G.data_rows(sheets, heads.filter("header_idx is not null").drop("top")))
    cell = lambda name: cell_at(F.col("cells"), F.col("header"), name)
    takeaway = F.col("sheet") == P.TAKEAWAY_SHEET
    lacks = F.array_contains("header", P.AMOUNT_COLUMN) & is_empty_cell(cell(P.AMOUNT_COLUMN))
    per = rows.groupBy("file", "sheet", F.when(takeaway, strip(cell(P.PLATFORM_COLUMN))).alias("platform")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lacks).alias("n_empty"),
        F.count_if(takeaway & (strip(cell(P.STATUS_COLUMN)) == P.TAKEAWAY_RETURNED)).alias("n_returned"),
    )
    sums = per.groupingSets([["file", "sheet"], ["file", "sheet", "platform"]], "file", "sheet", "platform").agg(
        F.grouping("platform").alias("whole"), F.sum("n").alias("n"), F.sum("n_empty").alias("n_empty"), F.sum("n_returned").alias("n_returned")
    )
    whole = F.col("whole") == 1
    return _lines(
        sums,
        F.when(whole, _line("Info", "orders", F.col("n"))),
        F.when(whole & (F.col("n_empty") > 0), _line("Warning", "empty_amounts", F.col("n_empty"))),
        F.when(whole & (F.col("n_returned") > 0), _line("Warning", "returns", F.col("n_returned"))),
        F.when(~whole & ~is_empty_cell(F.col("platform")), _line("Info", "platform", F.col("platform"))),
    )


def precheck_visits(grid: DataFrame) -> DataFrame:
    """Lines from the other files: visits and stores of a visit file, stores mixed in one file, files of no known kind."""
    # Both have a row or two per file, so that the rows meet them where they are read.
    kinds = stored(G.detect_file_kind(grid), "kinds")
    visits = grid.join(kinds.filter(F.col("kind") == "visits"), "file", "left_semi")
    head = stored(visits.filter("row_idx = 0").select("file", "sheet", F.col("cells").alias("header")), "heads")
    rows = visits.join(head, ["file", "sheet"])
    data = F.col("row_idx") > 0
    raw = strip(cell_at(F.col("cells"), F.col("header"), P.VISIT_STORE_COLUMN))
    store = F.when(data & ~is_empty_cell(raw), normalize_store(raw)).alias("store")
    per = rows.groupBy("file", store).agg(F.count_if(data).alias("n"))
    sums = per.groupingSets([["file"], ["file", "store"]], "file", "store").agg(
        F.grouping("store").alias("whole"), F.sum("n").alias("n"), F.count("store").alias("n_stores")
    )
    whole = F.col("whole") == 1
    lines = _lines(
        sums,
        F.when(whole, _line("Info", "visits", F.col("n"))),
        F.when(whole & (F.col("n_stores") > 1), _line("Warning", "mixed_stores", F.col("n_stores"))),
        F.when(~whole & F.col("store").isNotNull(), _line("Info", "store", F.col("store"))),
    )
    unknown = kinds.filter(F.col("kind") == "unknown")
    return lines.unionByName(_lines(unknown, _line("Warning", "unknown_file", F.col("file"))))


def precheck_history(periods: DataFrame, known: DataFrame, closures: DataFrame, mode: str) -> DataFrame:
    """Lines that compare files with the history before they are loaded.

    periods (file, store_name, period_start, period_end), known (store, biz_date) in any number of rows a day. Info:
    days of the file's period that the history lacks (`new_days`) and has (`existing_days`), none for a file without
    a valid period. Warning `little_history`: the period before, or the same one a year before, of the week or month
    in which the file begins has days, closed ones aside, without an order of its store.
    """
    held = known.select(F.col("store").alias("store_name"), F.col("biz_date").alias("day")).distinct().withColumn("held", F.lit(True))
    spine = date_spine(periods)
    days = spine.join(held, ["store_name", "day"], "left").groupBy("file").agg(
        F.count_if(F.col("held").isNull()).alias("new"), F.count_if("held").alias("old"),
        *[f(F.when(F.col("held"), F.col("day"))).alias(n) for n, f in (("first", F.min), ("last", F.max))],
    )
    news = _lines(
        days,
        _line("Info", "new_days", F.col("new")),
        F.when(F.col("old") > 0, _line("Info", "existing_days", F.format_string("%d (%s~%s)", "old", F.col("first").cast("string"), F.col("last").cast("string")))),
    )
    begin = F.date_trunc(mode, F.min("day").cast("timestamp_ntz")).cast("date").alias("period")
    files = spine.groupBy("file", "store_name").agg(begin)
    bounds = period_bounds(files.select(F.col("period").alias("order_date")), mode).filter("role <> 'current'")
    wanted = files.join(bounds, "period").select("file", "store_name", "role", "start", "end", F.explode(F.sequence("start", "end")).alias("day"))
    lacking = _open_days(wanted.join(held, ["store_name", "day"], "left_anti"), closures).groupBy("file", "role", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    detail = F.format_string("%s %s~%s: %d", "role", F.col("start").cast("string"), F.col("end").cast("string"), "n")
    return news.unionByName(_lines(lacking, _line("Warning", "little_history", detail)))
