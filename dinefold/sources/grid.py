"""Raw spreadsheet grids: (file, sheet, row_idx, cells), many files at once.

Every step is an aggregate or a join keyed by file and sheet, so no file is read as a whole
by one task. Header and metadata tables have one row per sheet and are joined without a
broadcast hint: their size grows with the number of files, the engine decides by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.functions.cells import cell_at, strip

# Per sheet: id column (also the header keyword) and the first row that is looked at. Order
# exports are read with their first row as column names, so that row is never scanned.
SHEETS = {P.ORDERS_SHEET: (P.POS_ID, 1), P.ITEMS_SHEET: (P.POS_ID, 1), P.TAKEAWAY_SHEET: (P.TAKEAWAY_ID, 0)}
POS_SHEETS = (P.ORDERS_SHEET, P.ITEMS_SHEET)
META_KEYS = (P.STORE_COLUMN, P.ORDER_TIME_COLUMN, P.BUSINESS_DATE_COLUMN)
META_ROWS = 15
VISIT_WORDS = ("订单号", "就餐人数", "语音转录", "总体满意度评分")


def _per_sheet(pick) -> Column:
    out = None
    for sheet, spec in SHEETS.items():
        out = F.when(F.col("sheet") == sheet, F.lit(pick(spec))) if out is None else out.when(
            F.col("sheet") == sheet, F.lit(pick(spec))
        )
    return out


def id_column() -> Column:
    return _per_sheet(lambda s: s[0])


def first_row() -> Column:
    return _per_sheet(lambda s: s[1])


def known_sheets(grid: DataFrame) -> DataFrame:
    return grid.filter(F.col("sheet").isin(*SHEETS))


def _texts() -> Column:
    return F.transform(F.filter("cells", lambda c: c.isNotNull() & (c != "nan")), strip)


def sheet_heads(grid: DataFrame) -> DataFrame:
    """One row per (file, sheet) from one pass: its header row and its first rows.

    `top` holds the texts of at most 15 rows, `header_idx` is null without a header.
    """
    key = id_column()
    scanned = F.col("row_idx") >= first_row()
    # The keyword holds no separator, so it is in a cell if and only if it is in the joined row.
    hit = F.contains(F.array_join("cells", "\x1f"), key)
    in_top = scanned & (F.col("row_idx") < first_row() + META_ROWS) & (F.col("sheet") != P.ITEMS_SHEET)
    return (
        known_sheets(grid)
        .groupBy("file", "sheet")
        .agg(
            F.min(F.when(scanned & hit, F.struct("row_idx", "cells"))).alias("h"),
            F.array_sort(F.collect_list(F.when(in_top, F.struct("row_idx", _texts().alias("vals"))))).alias("top"),
        )
        .select("file", "sheet", F.col("h.row_idx").alias("header_idx"), F.col("h.cells").alias("header"), "top")
    )


def locate_headers(grid: DataFrame) -> DataFrame:
    """Per (file, sheet) the first row with a cell that contains the keyword."""
    return sheet_heads(grid).filter("header_idx is not null").drop("top")


def data_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header, with the header of their sheet."""
    return known_sheets(grid).join(headers, ["file", "sheet"]).filter(F.col("row_idx") > F.col("header_idx"))


def grid_to_table(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project data rows to columns, given as {header name: output name}."""
    return rows.select(
        "file", "sheet", "row_idx", *[cell_at(F.col("cells"), F.col("header"), h).alias(n) for h, n in columns.items()]
    )


def drop_all_null_columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns that stay: those with a value in at least one row below the header."""
    cells = rows.select("file", "sheet", F.posexplode("cells").alias("pos", "v")).filter("v is not null")
    used = cells.select("file", "sheet", "pos").distinct().join(headers, ["file", "sheet"])
    return used.filter(F.col("pos") < F.size("header")).select(
        "file", "sheet", "pos", F.get(F.col("header"), F.col("pos")).alias("column")
    )


def with_metadata(heads: DataFrame) -> DataFrame:
    """Store, order time and business date written above the header, per sheet.

    A key is paired with the next non-null cell of its row; the first occurrence counts and
    the scan ends at the header row or after 15 rows.
    """
    is_header = lambda r: F.exists(r["vals"], lambda v: v.isin(P.POS_ID, P.TAKEAWAY_ID))
    stop = F.array_min(F.transform(F.filter("top", is_header), lambda r: r["row_idx"]))
    above = F.filter("top", lambda r: F.col("stop").isNull() | (r["row_idx"] < F.col("stop")))

    def value_after(key):
        def of(r):
            pos = F.array_position(r["vals"], key)
            return F.when(pos > 0, F.get(r["vals"], pos.cast("int")))

        return F.get(F.filter(F.transform("above", of), lambda v: v.isNotNull()), F.lit(0))

    return (
        heads.withColumn("stop", stop)
        .withColumn("above", above)
        .withColumns({n: value_after(k) for k, n in zip(META_KEYS, ("store_raw", "time_text", "business_text"))})
        .drop("stop", "above", "top")
    )


def sheet_metadata(grid: DataFrame) -> DataFrame:
    """Metadata per file: that of its order or takeaway sheet."""
    heads = sheet_heads(grid.filter(F.col("sheet") != P.ITEMS_SHEET))
    return with_metadata(heads).select("file", "store_raw", "time_text", "business_text")


def file_period(meta: DataFrame, takeaway: bool = False) -> DataFrame:
    """Canonical store and declared period: metadata first, else the file name."""
    text = F.coalesce(F.nullif("time_text", F.lit("")), F.col("business_text")) if takeaway else F.col("time_text")
    from_meta = B.range_start(text).isNotNull()
    raw = F.coalesce("store_raw", F.lit(""))
    return meta.withColumns(
        {
            "store_raw": raw,
            "store_name": B.normalize_store(raw),
            "period_start": F.when(from_meta, B.range_start(text)).otherwise(B.range_start(F.col("file"))),
            "period_end": F.when(from_meta, B.range_end(text)).otherwise(B.range_end(F.col("file"))),
        }
    ).drop("time_text", "business_text")


def required_sheets(grid: DataFrame, sheets=POS_SHEETS) -> DataFrame:
    """Expected sheets a file does not have; files without any of them are not looked at."""
    seen = grid.filter(F.col("sheet").isin(*sheets)).select("file", "sheet").distinct()
    want = seen.select("file").distinct().withColumn("sheet", F.explode(F.array(*[F.lit(s) for s in sheets])))
    return want.join(seen, ["file", "sheet"], "left_anti")


def detect_file_kind(grid: DataFrame) -> DataFrame:
    """pos, visits, takeaway or unknown, by sheets, header words and file name."""

    def any_row(cond):
        return F.coalesce(F.bool_or(cond), F.lit(False))

    def has(word):
        return F.exists("cells", lambda c: F.coalesce(strip(c) == word, F.lit(False)))

    words = F.lit(True)
    for w in VISIT_WORDS:
        words = words & has(w)
    seen = grid.groupBy("file").agg(
        any_row(F.col("sheet") == P.ORDERS_SHEET).alias("orders_sheet"),
        any_row(F.col("sheet") == P.ITEMS_SHEET).alias("items_sheet"),
        any_row(F.col("sheet") == P.TAKEAWAY_SHEET).alias("takeaway_sheet"),
        any_row((F.col("row_idx") == 0) & words).alias("visit_header"),
        any_row((F.col("row_idx") < 20) & has(P.TAKEAWAY_ID)).alias("takeaway_header"),
    )
    return seen.select(
        "file",
        F.when(F.col("file").contains(P.ORDERS_SHEET) | (F.col("orders_sheet") & F.col("items_sheet")), "pos")
        .when(F.col("file").contains("桌探数据") | F.col("visit_header"), "visits")
        .when(F.col("takeaway_sheet") | F.col("takeaway_header"), "takeaway")
        .otherwise("unknown")
        .alias("kind"),
    )
