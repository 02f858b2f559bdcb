"""Ingest checks: facts and edge cases on hand-made grids."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.functions.cells import is_digit_id, is_empty_cell, parse_time
from dinefold.operators import validation as V
from dinefold.sources import config as CFG
from dinefold.sources import grid as G
from dinefold.sources.visits_csv import read_visits

GRID = "file string, sheet string, row_idx bigint, cells array<string>"
NAME = "万荷店内订单明细2024-01-01+00_00_00~2024-01-03+23_59_59.xlsx"
HEAD = ["订单号", "下单时间", "就餐人数"]


def grid(spark, sheets, file=NAME):
    rows = [(file, sheet, i, cells) for sheet, lines in sheets.items() for i, cells in enumerate(lines) if cells is not None]
    return spark.createDataFrame(rows, GRID)


def days(*ds, start=1):
    return [[str(start + i), f"2024-01-0{d} 12:00:00", "2"] for i, d in enumerate(ds)]


def pos(orders, items=None, head=HEAD):
    top = [["报表"], ["门店名称", None, "万荷餐厅"], ["下单时间", "2024-01-01 ~ 2024-01-03"], head]
    return {P.ORDERS_SHEET: top + orders, P.ITEMS_SHEET: [["报表"], HEAD[:1], *(items or [["1"]])]}


def check(spark, sheets, schema=None, closures=None, file=NAME):
    frame = V.closures_frame(spark, closures or {})
    return V.validate_pos(grid(spark, sheets, file), schema or {}, frame).first()


def test_sound_file(spark):
    r = check(spark, pos(days(1, 2, 3)))
    assert r["ok"] and r["errors"] == "" and r["store_name"] == P.STORE_A
    assert (r["period_start"], r["period_end"]) == ("2024-01-01", "2024-01-03")


def test_missing_column(spark):
    r = check(spark, pos(days(1, 2, 3)), {"pos_orders": {"required": ["订单号", "会员手机号", "就餐人数"]}})
    assert r["errors"] == "店内订单明细：相对标准缺少 1 列：会员手机号（请重新导出包含全部列的 Excel）"


def test_blank_cell_nullable_and_dash(spark):
    rows = days(1, 2, 3)
    rows[0][2] = " NaN "
    rows[1][2] = "-"
    r = check(spark, pos(rows), {"pos_orders": {"required": HEAD}})
    assert r["errors"] == "店内订单明细：列「就餐人数」有 1 行空值（要求每列每条记录均有值）"
    assert check(spark, pos(rows), {"pos_orders": {"required": HEAD, "nullable": ["就餐人数"]}})["ok"]


def test_rows_without_digit_id_do_not_count(spark):
    rows = days(1, 2, 3) + [["合计", None, None], ["-", "x", None]]
    assert check(spark, pos(rows))["ok"]
    r = check(spark, pos([["a", "2024-01-01", "2"]]))
    assert r["errors"].startswith("店内订单明细：无有效数据行\n声明范围")


def test_all_null_column_counts_as_missing_but_a_total_row_keeps_it(spark):
    rows = [[*r[:2], None] for r in days(1, 2, 3)]
    req = {"pos_orders": {"required": HEAD}}
    assert "缺少 1 列：就餐人数" in check(spark, pos(rows), req)["errors"]
    kept = check(spark, pos(rows + [["合计", None, "6"]]), req)["errors"]
    assert "列「就餐人数」有 3 行空值" in kept


def test_missing_sheets_end_the_check(spark):
    r = check(spark, {P.ITEMS_SHEET: [["x"], HEAD, ["1", "", ""]]})
    assert r["errors"] == "缺少工作表「店内订单明细」" and r["store_name"] == ""


def test_first_row_of_order_sheets_is_no_header(spark):
    sheets = pos(days(1, 2, 3))
    sheets[P.ITEMS_SHEET] = [HEAD, ["1", "x", "y"]]
    r = check(spark, sheets)
    assert r["errors"] == "未找到含「订单号」的表头行" and r["store_name"] == P.STORE_A


def test_header_word_may_be_part_of_a_cell(spark):
    r = check(spark, pos(days(1, 2, 3), head=["外卖订单号", "下单时间", "就餐人数"]))
    assert r["errors"] == "店内订单明细：缺少必要列「订单号」"


def test_gaps_and_closures(spark):
    r = check(spark, pos(days(1)))
    assert "内缺 2 天订单数据：2024-01-02, 2024-01-03（" in r["errors"]
    assert check(spark, pos(days(1)), closures={P.ALL_STORES: ["2024-01-02"], P.STORE_A: ["2024-01-03"]})["ok"]
    other = check(spark, pos(days(1)), closures={P.ALL_STORES: ["2024-01-02"], P.STORE_B: ["2024-01-03"]})
    assert "内缺 1 天" in other["errors"]


def test_long_gap_lists_fifteen_days(spark):
    sheets = pos(days(1))
    sheets[P.ORDERS_SHEET][2] = ["下单时间", "2024-01-01 ~ 2024-01-31"]
    r = check(spark, sheets)
    assert "内缺 30 天" in r["errors"] and "2024-01-16 ...（" in r["errors"] and "2024-01-17" not in r["errors"]


def test_period_from_file_name_and_none(spark):
    sheets = pos(days(1, 2, 3))
    sheets[P.ORDERS_SHEET][2] = ["下单时间", "本周"]
    assert check(spark, sheets)["ok"]
    assert check(spark, sheets, file="店内订单明细.xlsx")["errors"] == V.MSG_NO_PERIOD


def test_impossible_range_is_reported(spark):
    sheets = pos(days(1))
    sheets[P.ORDERS_SHEET][2] = ["下单时间", "2024-02-30 ~ 2024-02-31"]
    assert check(spark, sheets)["errors"] == "声明范围 2024-02-30~2024-02-31 不是有效日期"


def test_missing_time_column(spark):
    sheets = pos([["1", "2"]], head=["订单号", "就餐人数"])
    assert check(spark, sheets)["errors"] == V.MSG_NO_TIME


def test_nine_columns_with_blanks(spark):
    names = [f"c{i}" for i in range(10)]
    r = check(spark, pos([[*row, *[""] * 10] for row in days(1, 2, 3)], head=[*HEAD, *names]))
    lines = r["errors"].split("\n")
    assert len(lines) == 9 and lines[0].startswith("店内订单明细：列「c0」") and lines[8] == "店内订单明细：另有 2 列存在空值，请全表检查"


def test_metadata_skips_nulls_first_wins_and_stops_at_header(spark):
    top = [["x"], ["门店名称", None, None, "保利广场"], ["门店名称", "万荷"], ["订单号", "下单时间"], ["下单时间", "2020-01-01~2020-01-02"]]
    m = G.sheet_metadata(grid(spark, {P.ORDERS_SHEET: top})).first()
    assert (m["store_raw"], m["time_text"]) == ("保利广场", None)


def test_takeaway_first_row_counts_and_dates_are_optional(spark):
    sheet = {P.TAKEAWAY_SHEET: [["营业日", "2024-01-01~2024-01-02"], ["外卖订单号", "营业日"], ["1", "2024-01-01"]]}
    g, none = grid(spark, sheet, "a.xlsx"), V.closures_frame(spark, {})
    assert V.validate_takeaway(g, {}, none).first()["ok"]
    strict = V.validate_takeaway(g, {}, none, strict_dates=True).first()
    assert "内缺 1 天订单数据：2024-01-02" in strict["errors"] and strict["store_name"] == P.STORE_UNKNOWN
    undated = grid(spark, {P.TAKEAWAY_SHEET: [["外卖订单号", "x"], ["1", "y"]]}, "a.xlsx")
    assert V.validate_takeaway(undated, {}, none, strict_dates=True).first()["ok"]


def test_gate(spark, tmp_path):
    report = V.validate_pos(grid(spark, pos(days(1))), {}, V.closures_frame(spark, {}))
    with pytest.raises(V.ValidationFailed) as e:
        V.fail_gate(report)
    assert V.MSG_GATE in str(e.value) and "1 files, 1 issues" in str(e.value) and e.value.issues.count() == 1
    many = report
    for i in range(24):
        many = many.unionByName(report.withColumn("file", F.lit(f"f{i}")))
    with pytest.raises(V.ValidationFailed) as e:
        V.fail_gate(many, str(tmp_path / "issues"))
    assert "25 files, 25 issues" in str(e.value) and str(tmp_path) in str(e.value) and e.value.issues.count() == 25
    V.fail_gate(V.validate_pos(grid(spark, pos(days(1, 2, 3))), {}, V.closures_frame(spark, {})))


def test_many_files(spark):
    g = grid(spark, pos(days(1, 2, 3))).unionByName(grid(spark, pos(days(1)), "b" + NAME))
    files = V.pos_files(g, {}, V.closures_frame(spark, {}))
    assert [r["error"][: len(NAME) + 3] for r in V.validate_many(files).collect()] == [f"[b{NAME}]"]
    levels = {(r["file"], r["level"]) for r in V.precheck_levels(files).collect()}
    assert ("b" + NAME, "Error") in levels and (NAME, "Error") not in levels and (NAME, "Info") in levels


def test_configuration(spark, tmp_path):
    path = tmp_path / "closures.json"
    path.write_text(json.dumps({"_comment": "x", P.ALL_STORES: ["2024-02-10"], P.STORE_A: ["2023-10-10", "2023-10-17"], "bad": 3}), encoding="utf-8")
    cal = CFG.closure_calendar(CFG.read_documents(spark, str(path)))
    stores = spark.createDataFrame([("closures.json", P.STORE_A), ("closures.json", P.STORE_B)], "file string, store string")
    allowed = {(r["store"], r["closed_date"]) for r in CFG.allowed_missing_dates(cal, stores).collect()}
    assert allowed == {(P.STORE_A, d) for d in ("2024-02-10", "2023-10-10", "2023-10-17")} | {(P.STORE_B, "2024-02-10")}
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps({"_note": {}, "takeaway": {"required": ["a"], "nullable": ["b"]}, "x": 1}), encoding="utf-8")
    rows = {(r["sheet"], r["column"], r["required"], r["nullable"]) for r in CFG.sheet_schema(CFG.read_documents(spark, str(schema))).collect()}
    assert rows == {("takeaway", "a", True, False), ("takeaway", "b", False, True)}


@pytest.mark.parametrize("text,empty", [(None, True), ("", True), ("　\t", True), (" NaT ", True), ("None", True), ("-", False), ("0", False)])
def test_empty_cells(spark, text, empty):
    assert spark.createDataFrame([(text,)], "c string").select(is_empty_cell(F.col("c"))).first()[0] is empty


@pytest.mark.parametrize("text,ok", [("123", True), ("１２", True), ("1a", False), ("1\n", False), ("", False), (None, False)])
def test_digit_ids(spark, text, ok):
    assert spark.createDataFrame([(text,)], "c string").select(is_digit_id(F.col("c"))).first()[0] is ok


@pytest.mark.parametrize(
    "text,day",
    [("2024-01-05 10:00:00", "2024-01-05"), ("2024/1/5", "2024-01-05"), ("2024-01-05 10:30", "2024-01-05"), ("2024-02-30", None), ("45000", None), ("x", None)],
)
def test_times(spark, text, day):
    out = spark.createDataFrame([(text,)], "c string").select(F.date_format(parse_time(F.col("c")), "yyyy-MM-dd")).first()[0]
    assert out == day


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_microseconds_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.sql("select timestamp_ntz'2024-03-10 03:30:00.25' a, timestamp_ntz'1969-12-31 23:59:59' b").select(B.micros(F.col("a")), B.micros(F.col("b"))).first()
        assert tuple(got) == (1710041400250000, -1000000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_visit_csv_with_mark_and_line_breaks(spark, tmp_path):
    text = '﻿订单号,就餐人数,语音转录,创建时间\n123,3,"好吃\n下次来",2024-01-05 10:00:00\n,x,,bad\n'
    (tmp_path / "桌探数据.csv").write_text(text, encoding="utf-8")
    rows = read_visits(spark, str(tmp_path)).collect()
    assert [(r["order_no"], r["guests"], r["transcript"]) for r in rows] == [("123", 3, "好吃\n下次来"), (None, None, None)]
    assert rows[0]["created_at"].hour == 10 and rows[1]["created_at"] is None


def test_column_stats_count_patterns(spark):
    """Short rows, nulls, empty words, several days, a row without a valid id; equal rows count each."""
    schema = "file string, sheet string, width int, id_pos int, time_pos int, date_pos int, cells array<string>"
    row = lambda *cells: ("f", "s", 4, 0, 2, 3, list(cells))
    rows = [
        row("1", "x", "2024-01-01 10:00", "2024-01-01"), row("1", "x", "2024-01-01 10:00", "2024-01-01"),
        row("2", " ", "2024-01-02 10:00", None), row("3", None), row("合计", "x", "2024-01-09 10:00", "2024-01-09"), row(),
        row("4", "nan", "2024/1/3", "2024-01-04", "beyond the header"),
    ]
    stats = V.column_stats(spark.createDataFrame(rows, schema))
    got = {r["pos"]: (r["filled"], r["n_valid"], r["n_full"], sorted(d.day for d in r["days"])) for r in stats.collect()}
    assert got == {0: (True, 5, 5, []), 1: (True, 5, 2, []), 2: (True, 4, 4, [1, 2, 3]), 3: (True, 4, 3, [1, 4])}
    assert "posexplode(slice" not in stats._jdf.queryExecution().toString().lower()


def test_precheck_lines_from_rows(spark):
    """Orders, empty amounts, returns, platforms, visits, mixed stores and unknown files; rows without a valid id don't count."""
    take, csv_head = "t.xlsx", ["订单号", "就餐人数", "店面", "语音转录", "总体满意度评分"]
    rows = [
        ("p.xlsx", P.ORDERS_SHEET, 1, ["订单号", "订单金额"]), ("p.xlsx", P.ORDERS_SHEET, 2, ["1", "5"]), ("p.xlsx", P.ORDERS_SHEET, 3, ["2", None]),
        ("p.xlsx", P.ORDERS_SHEET, 4, ["合计", ""]), ("p.xlsx", P.ITEMS_SHEET, 1, ["订单号"]), ("p.xlsx", P.ITEMS_SHEET, 2, ["1"]),
        (take, P.TAKEAWAY_SHEET, 0, ["外卖订单号", "订单来源", "订单状态"]),
        (take, P.TAKEAWAY_SHEET, 1, ["1", "美团外卖", "已退单 "]), (take, P.TAKEAWAY_SHEET, 2, ["2", " 美团外卖", "已完成"]),
        (take, P.TAKEAWAY_SHEET, 3, ["3", None, None]), (take, P.TAKEAWAY_SHEET, 4, ["-", "饿了么", "已退单"]),
        ("v.csv", "csv", 0, csv_head), ("v.csv", "csv", 1, ["1", "2", "万荷餐厅", "", "5"]), ("v.csv", "csv", 2, ["2", "2", "保利广场店", "", "5"]),
        ("v.csv", "csv", 3, ["3", "2", None, "", "5"]), ("桌探数据.csv", "csv", 0, csv_head), ("x.csv", "csv", 0, ["a", None]),
    ]
    g = spark.createDataFrame(rows, "file string, sheet string, row_idx long, cells array<string>")
    got = sorted(map(tuple, V.precheck_orders(g).unionByName(V.precheck_visits(g)).collect()))
    assert got == sorted([
        ("p.xlsx", "Info", "orders", "2"), ("p.xlsx", "Warning", "empty_amounts", "1"),
        (take, "Info", "orders", "3"), (take, "Warning", "returns", "1"), (take, "Info", "platform", "美团外卖"),
        ("v.csv", "Info", "visits", "3"), ("v.csv", "Info", "store", "万荷店"), ("v.csv", "Info", "store", "保利店"),
        ("v.csv", "Warning", "mixed_stores", "2"), ("桌探数据.csv", "Info", "visits", "0"), ("x.csv", "Warning", "unknown_file", "x.csv"),
    ])
    none = g.limit(0)
    assert V.precheck_orders(none).count() == V.precheck_visits(none).count() == 0


def test_gate_counts_while_it_writes(spark, tmp_path):
    good = V.validate_pos(grid(spark, pos(days(1, 2, 3))), {}, V.closures_frame(spark, {}))
    sink = str(tmp_path / "issues")
    V.fail_gate(good, sink)
    assert spark.read.schema("file string, text string").parquet(sink).count() == 0
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        runs.add(1)
        return text

    bad = V.validate_pos(grid(spark, pos(days(1))), {}, V.closures_frame(spark, {}))
    with pytest.raises(V.ValidationFailed) as e:
        V.fail_gate(bad.withColumn("errors", counted("errors")), sink)
    assert "1 files, 1 issues" in str(e.value) and e.value.issues.count() == 1 and runs.value == 1


def test_precheck_against_the_history(spark):
    from datetime import date

    files = spark.createDataFrame(
        [("a", "s", "2024-01-15", "2024-01-21"), ("b", "t", "2024-01-15", "2024-01-15"), ("c", "s", None, None), ("d", "s", "x", "y"), ("e", None, "2024-01-15", "2024-01-16")],
        "file string, store_name string, period_start string, period_end string",
    )
    held = [("s", date(2024, 1, d)) for d in [*range(8, 15), 15, 17] for _ in range(3)] + [("s", date(2023, 1, d)) for d in range(16, 21)]
    known = spark.createDataFrame([*held, ("t", None), (None, date(2024, 1, 8))], "store string, biz_date date")
    closures = V.closures_frame(spark, {"s": ["2023-01-21"], P.ALL_STORES: ["2024-01-10"]})
    rows = V.precheck_history(files, known, closures, "week")
    got = sorted(map(tuple, rows.filter("file <> 'e'").collect()))
    assert got == sorted([
        ("a", "Info", "new_days", "5"), ("a", "Info", "existing_days", "2 (2024-01-15~2024-01-17)"),
        ("a", "Warning", "little_history", "last_year 2023-01-16~2023-01-22: 1"),
        ("b", "Info", "new_days", "1"), ("b", "Warning", "little_history", "previous 2024-01-08~2024-01-14: 6"),
        ("b", "Warning", "little_history", "last_year 2023-01-16~2023-01-22: 7"),
    ])
    # A file of no known store has no history at all.
    assert {r["detail"] for r in rows.filter("file = 'e'").collect()} >= {"2", "previous 2024-01-08~2024-01-14: 6"}
    month = V.precheck_history(files, known, closures, "month").filter("file = 'b' and level = 'Warning'").collect()
    assert {r["detail"] for r in month} == {"previous 2023-12-01~2023-12-31: 31", "last_year 2023-01-01~2023-01-31: 31"}
    assert V.precheck_history(files.limit(0), known, closures, "week").count() == 0
    assert V.precheck_history(files, known.limit(0), closures, "week").filter("code = 'existing_days'").count() == 0


def test_patterns_are_made_once(spark):
    """A filter on patterns was moved below their counts, so that each row's cells were looked at twice."""
    g = grid(spark, pos(days(1, 2, 3)))
    plan = V.null_cells_by_column(V.sheet_report(g), {})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(transform(") == 1


def test_heads_are_found_once(spark, monkeypatch):
    """Each part of the precheck found the heads anew, and the checks twice each: for the rows and for the columns."""
    from dinefold.plans import validation as PV
    from dinefold.sources import grid as G

    calls = []
    real = G.sheet_heads
    monkeypatch.setattr(G, "sheet_heads", lambda g: calls.append(1) or real(g))
    lines = PV.precheck_levels(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and {r["level"] for r in lines.collect()} == {"Error", "Warning", "Info"}
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "min(CASE WHEN" not in plan


def test_the_first_character_decides_as_the_whole_text_does(spark):
    starts = ["", " ", "　", "\x85", "\xa0", "\x1f", "!", "-", "0", "9", "A", "M", "N", "O", "a", "m", "n", "o", "z", "~", "\x7f", "é", "、", "桌", "😀", "Ｎ"]
    texts = [a + b for a in starts for b in ("", "an", "AN", "one", "aT", "aN ", "anx", " nan", "　None\t")]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select("c", is_empty_cell(F.col("c")).alias("e")).collect()
    assert {r["c"]: r["e"] for r in got} == {t: t.strip().lower() in ("", "nan", "none", "nat") for t in texts}
    assert spark.range(1).select(F.lit("桌1").alias("c")).select(is_empty_cell(F.col("c"))).first()[0] is False


@pytest.mark.parametrize("text,time", [("2024/1/5 9:05", "2024-01-05 09:05:00"), (" 2024-12-31T23:59 ", "2024-12-31 23:59:00"), ("2024-01-05 10:30:15.5", "2024-01-05 10:30:15"), ("2024-01-05 25:00", None), ("1/2/2024", None)])
def test_times_with_and_without_slashes_and_seconds(spark, text, time):
    assert spark.createDataFrame([(text,)], "c string").select(F.date_format(parse_time(F.col("c")), "yyyy-MM-dd HH:mm:ss")).first()[0] == time
