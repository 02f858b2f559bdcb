"""Facts of dedup, revenue policies, counts and marts."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.operators import cleaning as C
from dinefold.operators import drinks as D
from dinefold.operators import periods as PD
from dinefold.operators import reports as R
from dinefold.operators import takeaway as T
from dinefold.operators import visits as VI
from dinefold.sources import store as S
from tests.helpers import ORDER, frames, order

LINE = "order_no string, seq int, sku string, name string, qty int, item_revenue int, load_seq bigint"
NO = "112606251701474802700038"


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE)


def test_repeated_product_lines_stay(spark):
    df = lines(spark, [(NO, 1, "D1", "气泡水", 10, 380, 1), (NO, 2, "D1", "气泡水", 3, 114, 1)])
    out = C.item_line_dedup(df, ["load_seq"])
    assert out.count() == 2 and out.agg(F.sum("qty")).first()[0] == 13


def test_same_line_sequence_is_replaced(spark):
    df = lines(spark, [(NO, 1, "D1", "气泡水", 10, 380, 1), (NO, 1, "D1", "气泡水", 11, 418, 2)])
    rows = C.item_line_dedup(df, ["load_seq"]).collect()
    assert [r["qty"] for r in rows] == [11]
    raw = S.rows_to_json(C.item_line_dedup(df, ["load_seq"]), ["order_no"])
    assert S.rows_from_json(raw, LINE).first()["qty"] == 11


def test_overlapping_archives(spark):
    old = lines(spark, [("1001", 1, "S", "气泡水", 10, 0, 0), ("1001", 2, "S", "气泡水", 3, 0, 0)]).drop("load_seq")
    new = lines(spark, [("1001", 1, "S", "气泡水", 11, 0, 0)]).drop("load_seq")
    out = S.merge_archives(old, new, ["order_no", "sku", "name", "seq"])
    assert sorted((r["seq"], r["qty"]) for r in out.collect()) == [(1, 11), (2, 3)]
    orders = spark.createDataFrame([("1001", "万荷餐厅", 0), ("1001", "万荷餐厅", 1)], "order_no string, store string, load_seq int")
    assert S.upsert_latest(orders, ["order_no"], ["load_seq"]).count() == 1


def test_latest_row_with_a_null_field_wins_as_a_whole(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, v int, t string")
    assert S.upsert_latest(df, ["k"], ["v"]).collect() == [("a", 2, None)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"), F.lit("x").alias("t"))
    out = S.upsert_latest(df, ["k"], ["v"])
    assert "partial_max" in out._jdf.queryExecution().toString()
    assert out.filter("k = 0").first()["v"] == 19999


ITEM = "name string, category string, qty decimal(18,2), item_revenue decimal(18,2), sale_type string"


def sold(spark, rows):
    return C.sold_items(spark.createDataFrame([(n, c, Decimal(q), Decimal(str(r)), s) for n, c, q, r, s in rows], ITEM))


def test_lines_without_revenue_do_not_count(spark):
    beer = "朝日啤酒（黄啤）"
    s = sold(spark, [(beer, "啤酒", 105, 2940, None), (beer, "啤酒", 4, 0, None), (beer, "啤酒", 9, 0, None)])
    assert s.agg(F.sum("qty"), F.sum("item_revenue")).first() == (105, 2940)
    assert PD.drink_ranking(s, []).collect() == [(beer, "啤酒", Decimal(105))]
    assert R.dish_sales(s, {beer: []}).collect() == [(beer, Decimal(105))]


def test_package_parents_go_children_stay(spark):
    s = sold(
        spark,
        [("双人餐", "套餐", 1, "223.72", "套餐"), ("果茶（杯）", "调饮汁", 2, "50.01", "套餐子项"), ("肉丝", "炒菜", 1, 75, "单品"), ("可乐", "饮料和水果", 1, 15, None)],
    )
    out = {r["category"]: r["r"] for r in s.groupBy("category").agg(F.sum("item_revenue").alias("r")).collect()}
    assert out == {"调饮汁": Decimal("50.01"), "炒菜": 75, "饮料和水果": 15}


def test_items_without_a_sale_type_column(spark):
    df = spark.createDataFrame([("a", Decimal(5))], "name string, item_revenue decimal(18,2)")
    assert C.sold_items(df).count() == 1


def test_drink_scope_has_coffee_and_ice_cream():
    assert len(P.DRINK_CATEGORIES) == 11
    assert {"咖啡", "冰淇淋"} <= set(P.DRINKS_SOFT)


@pytest.mark.parametrize(
    "name,core",
    [("果茶（杯）", "果茶"), ("啤酒大瓶", "啤酒"), ("啤酒（黄啤）", "啤酒（黄啤）"), ("汤(盅)", "汤"), ("杯", "杯"), ("酸梅汤 壶", "酸梅汤"), ("茶", "茶")],
)
def test_core_name(spark, name, core):
    assert spark.range(1).select(B.core_name(F.lit(name))).first()[0] == core


def test_counts_do_not_mix_stores(spark):
    rows = [order(i, 600, 10, store=P.STORE_A) for i in range(49)] + [order(100 + i, 600, 10, "外点自取", store=P.STORE_A) for i in range(2)]
    rows += [order(200 + i, 600, 10, store=P.STORE_B) for i in range(21)]
    out = {r["store"]: (r["raw_orders"], r["takeaway_orders"]) for r in C.pre_merge_counts(spark.createDataFrame(rows, ORDER)).collect()}
    assert out == {P.STORE_A: (51, 2), P.STORE_B: (21, 0), None: (72, 2)}


def test_mart_rerun_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "mart")
    schema = "store string, day string, n int"
    S.mart_overwrite(spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2)], schema), path, ["day"])
    S.mart_overwrite(spark.createDataFrame([("a", "d2", 5)], schema), path, ["day"])
    assert sorted((r["day"], r["n"]) for r in spark.read.parquet(path).collect()) == [("d1", 1), ("d2", 5)]


def test_one_store_rerun_keeps_the_other_store(spark, tmp_path):
    path = str(tmp_path / "mart")
    schema = "store string, day string, n int"
    S.mart_overwrite(spark.createDataFrame([("a", "d1", 1), ("b", "d1", 2)], schema), path, ["day", "store"])
    for _ in range(2):
        S.mart_overwrite(spark.createDataFrame([("a", "d1", 7)], schema), path, ["day", "store"])
        assert sorted((r["store"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2)]


def test_files_with_further_columns(spark, tmp_path):
    spark.createDataFrame([("k1", 1)], "k string, v int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("k1", 2, "x"), ("k2", 3, "y")], "k string, v int, extra string").write.parquet(str(tmp_path / "b"))
    rows = S.multi_file_load(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["k"], ["v"]).collect()
    assert sorted((r["k"], r["v"], r["extra"]) for r in rows) == [("k1", 2, "x"), ("k2", 3, "y")]


def test_csv_columns_go_by_name(spark, tmp_path):
    """Files with other column orders, more columns, quotes and a byte order mark give the same rows."""
    (tmp_path / "a.csv").write_text("k,v,t\nx,1,1\ny,2,1\n")
    (tmp_path / "b.csv").write_text('extra,k,t,v\nq,x,2,"7, or 8"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text('"t",v,k\n3,9,z\n', encoding="utf-8-sig")
    (tmp_path / "d.csv").write_text("")
    rows = S.multi_file_load(spark, [str(tmp_path / f"{n}.csv") for n in "abcd"], ["k"], ["t"], fmt="csv").collect()
    got = {r["k"]: (r["v"], r["t"], r["extra"], r["source_file"]) for r in rows}
    assert got == {"x": ("7, or 8", "2", "q", "b.csv"), "y": ("2", "1", None, "a.csv"), "z": ("9", "3", None, "c.csv")}



def test_repeated_orders_match_a_visit_once(spark):
    visits = spark.createDataFrame([(1, "7")], "visit_id long, order_no string")
    orders = spark.createDataFrame([("7",), ("7",)], "order_no string")
    assert VI.visit_exact_match(visits, orders).count() == 1


@pytest.mark.parametrize("value,band", [(300, "300+"), (299.99, "200-300"), (100, "100-150"), (99.99, "<100")])
def test_price_bands(spark, value, band):
    assert spark.range(1).select(B.price_band(F.lit(value))).first()[0] == band


def test_empty_bands_show_zero(spark):
    g = spark.createDataFrame([("s", Decimal("120.00"))], "store string, per_capita decimal(18,2)")
    rows = {r["bucket"]: (r["n_groups"], r["share"]) for r in R.price_buckets(g, ["store"]).collect()}
    assert len(rows) == 5 and rows["100-150"] == (1, 1.0) and rows["300+"] == (0, 0.0)


def test_rank_equals_window_rank_with_ties_and_a_hot_value(spark):
    from pyspark.sql import Window as W

    rows = [("s", str(i), Decimal(i % 7) if i % 3 else Decimal("5.00")) for i in range(400)] + [("t", "x", None)]
    g = spark.createDataFrame(rows, "store string, group_id string, per_capita decimal(18,2)").filter("per_capita is not null")
    want = {(r["group_id"], r["k"]) for r in g.select("group_id", F.rank().over(W.partitionBy("store").orderBy(F.desc("per_capita"))).alias("k")).collect()}
    got = {(r["group_id"], r["per_capita_rank"]) for r in R.per_capita_rank(g, ["store"]).collect()}
    assert got == want


def test_period_bounds():
    from datetime import date

    w = PD.Period("week", date(2024, 1, 15)).bounds
    assert w["previous"] == (date(2024, 1, 8), date(2024, 1, 14)) and w["last_year"][0] == date(2023, 1, 16)
    m = PD.Period("month", date(2024, 3, 1)).bounds
    assert m["previous"] == (date(2024, 2, 1), date(2024, 2, 29)) and m["last_year"] == (date(2023, 3, 1), date(2023, 3, 31))
    with pytest.raises(ValueError):
        PD.Period("week", date(2024, 1, 16))


def test_revenue_closes(spark):
    """Both checks close over the reports; groups that the report filters out still count."""
    from datetime import date

    monday = date(2024, 1, 15)
    week = PD.Period("week", monday)
    frame = lambda rows, c: spark.createDataFrame([("s", monday, *r) for r in rows], f"store string, biz_date date, {c}")
    pos = frame([(Decimal(60),), (Decimal(40),)], "revenue decimal(18,2)")
    away = frame([(Decimal(40),)], "revenue decimal(18,2)")
    back = spark.createDataFrame([("s", Decimal(140))], "store string, revenue decimal(18,2)")
    totals = PD.whole_revenue(pos, away, week, ["store"])
    assert {r["metric"]: r["current"] for r in totals.collect()} == {"pos_revenue": 100.0, "takeaway_revenue": 40.0, "whole_revenue": 140.0}

    def checks(lines):
        sold = frame(lines, "category string, item_revenue decimal(18,2)")
        cats = PD.category_distribution(sold, week, ["store"])
        return {r["check"]: r["closes"] for r in PD.revenue_closure(totals, cats, back).collect()}

    assert checks([("茶", Decimal(70)), (None, Decimal(30))]) == {"total_is_pos_and_takeaway": True, "categories_are_pos": True}
    assert checks([("茶", Decimal(70)), ("汤", Decimal(29))]) == {"total_is_pos_and_takeaway": True, "categories_are_pos": False}


TAKE = (
    "store string, file string, source string, serial_no string, takeaway_id string, order_time timestamp_ntz, status string, "
    "delivery_status string, paid decimal(18,2), revenue decimal(18,2), recipient_name string, recipient_phone string, address string"
)


def take(no, status="已完成", store="万荷餐厅", file="x.xlsx", minute=0):
    return (store, file, "美团外卖", f"#{no}", no, datetime(2024, 1, 1, 10, minute), status, "已送达", Decimal(10), Decimal(8), "n", "p", "a")


def test_takeaway_cleaning_and_masking(spark):
    df = spark.createDataFrame(
        [take("1"), take("1", minute=5), take("2", "已退单"), take("-"), take("3", store=None, file="保利平台外卖.xlsx")], TAKE
    )
    out = T.takeaway_clean(df)
    assert not set(P.PERSONAL_COLUMNS) & set(out.columns)
    rows = {r["takeaway_id"]: r for r in out.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"]["order_time"].minute == 5 and rows["1"]["store"] == P.STORE_A and rows["3"]["store"] == P.STORE_B
    assert T.takeaway_clean(df, store=P.STORE_C).select("store").distinct().collect() == [(P.STORE_C,)]
    kinds = {r["takeaway_id"]: r["kind"] for r in T.takeaway_status(out).collect()}
    assert kinds == {"1": "valid", "2": "returned", "3": "valid"}


def test_no_registered_takeaway_query_shows_personal_data(spark):
    from dinefold.plans import all_queries

    for name, fn in all_queries().items():
        if name.startswith("takeaway"):
            assert not set(P.PERSONAL_COLUMNS) & set(fn(spark, "/root/testdata/sf0.001").columns), name


def test_distinct_groups_are_recounted_per_level(spark):
    rows = [("s", "g1", "茶", Decimal(1), Decimal(5)), ("s", "g1", "啤酒", Decimal(1), Decimal(5)), ("s", "g2", "茶", Decimal(1), Decimal(5))]
    sold_ = spark.createDataFrame(rows, "store string, group_id string, category string, qty decimal(18,2), item_revenue decimal(18,2)")
    groups = spark.createDataFrame([("s", "g1", 4), ("s", "g2", 6)], "store string, group_id string, guests int")
    money = spark.createDataFrame([("s", Decimal(100))], "store string, revenue decimal(18,2)")
    out = {r["scope"]: (r["n_groups"], r["attach_rate"], r["revenue_share"]) for r in D.drink_dimension_stats(sold_, groups, money, money, ["store"]).collect()}
    assert out == {"全部": (2, 0.3, 0.075), D.SOFT: (2, 0.2, 0.05), D.ALCOHOL: (1, 0.1, 0.025)}


def test_overview_shares_add_up(spark):
    from dinefold.operators import groups as G
    from tests.helpers import random_case

    o, i = frames(spark, *random_case(4, 200))
    rows = R.overview(G.kept(G.aggregate_groups(o, i)), ["store"]).collect()
    areas = sum(r["share"] for r in rows if r["daypart"] == R.ALL and r["area"] != R.ALL)
    parts = sum(r["share"] for r in rows if r["daypart"] != R.ALL and r["area"] == R.ALL)
    assert abs(areas - 1) < 1e-9 and abs(parts - 1) < 1e-9


def test_merging_only_the_compared_days_changes_nothing(spark):
    from datetime import date, timedelta

    from dinefold.operators import groups as G

    monday = date(2024, 3, 4)
    week = PD.Period("week", monday)
    times = [datetime(2024, 3, 3, 23, 58), datetime(2024, 3, 4, 0, 0), datetime(2024, 3, 10, 23, 59, 59), datetime(2024, 3, 11, 0, 1),
             datetime(2024, 2, 25, 12), datetime(2024, 2, 26, 12), datetime(2023, 3, 6, 12), datetime(2023, 3, 5, 12)]
    rows = [order(i, 0, 50 + i, order_time=t, guests=1 + i % 3) for i, t in enumerate(times)]
    o, i = frames(spark, rows, [("x", 1, "S", "n", "c", None, None, None, Decimal(1), Decimal(1), Decimal(1))])
    few = PD.orders_in_periods(o, week)
    assert sorted(r["order_no"] for r in few.select("order_no").collect()) == ["0", "1", "2", "5", "6"]
    late = PD.orders_in_periods(o, week, cutover_hour=6)
    assert "3" in [r["order_no"] for r in late.select("order_no").collect()]
    compare = lambda x: sorted(map(str, PD.period_compare(G.aggregate_groups(x, i), week, ["store"]).collect()))
    assert compare(o) == compare(few) and monday + timedelta(days=6) == week.bounds["current"][1]


def test_drink_sets_of_days_add_up_to_distinct_groups(spark):
    import random
    from datetime import date

    rnd = random.Random(3)
    cats = [*P.DRINK_CATEGORIES, "炒菜"]
    rows = [
        (rnd.choice(["a", "b"]), date(2024, 3, 4 + g % 5), None if g == 7 else f"g{g}", rnd.choice(cats), Decimal(1), Decimal(2))
        for g in range(60) for _ in range(rnd.randrange(0, 6))
    ]
    # A group lies in one store.
    rows = [("ab"[int((r[2] or "g0")[1:]) % 2], *r[1:]) for r in rows]
    sold_ = spark.createDataFrame(rows, "store string, biz_date date, group_id string, category string, qty decimal(18,2), item_revenue decimal(18,2)")
    groups = spark.createDataFrame([("a", 4), ("b", 6)], "store string, guests int")
    money = spark.createDataFrame([("a", Decimal(100)), ("b", Decimal(50))], "store string, revenue decimal(18,2)")
    totals = D._totals(groups, money, money, ["store"])
    daily = D.drinks_of(sold_, ["store", "biz_date"])

    def expected(level):
        out = {}
        for store, _, group, cat, qty, _ in rows:
            for name in level(cat) if cat in P.DRINK_CATEGORIES else ():
                of, portions = out.setdefault((store, name), (set(), []))
                of.add(group)
                portions.append(qty)
        return {k: (len(of - {None}), sum(q)) for k, (of, q) in out.items()}

    side = lambda c: D.SOFT if c in P.DRINKS_SOFT else D.ALCOHOL
    by_category = D.category_stats(daily, totals, ["store"])
    assert {(r["store"], r["category"]): (r["n_groups"], r["qty"]) for r in by_category.collect()} == expected(lambda c: [c])
    by_scope = D.dimension_stats(daily, totals, ["store"])
    assert {(r["store"], r["scope"]): (r["n_groups"], r["qty"]) for r in by_scope.collect()} == expected(lambda c: [side(c), R.ALL])
    for df in (by_category, by_scope):
        assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()
    none = sold_.limit(0)
    assert D.category_stats(D.drinks_of(none, ["store"]), totals, ["store"]).count() == 0
