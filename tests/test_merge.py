"""The merge against a plain loop, its rules one by one, and hot tables."""

from __future__ import annotations

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.operators import groups as G
from dinefold.operators import sessions as S
from dinefold.params import MergeParams
from tests.helpers import ORDER, frames, items_of, order, random_case

FIELDS = [c.split()[0] for c in ORDER.split(", ")]


def loop_merge(orders, items, p=MergeParams()):
    """Reference implementation: one order after the other."""
    lines: dict[str, list] = {}
    for it in items:
        lines.setdefault(it[0], []).append(it)
    rows = sorted((dict(zip(FIELDS, o)) for o in orders), key=lambda r: (r["order_time"], r["order_no"]))
    state, out = {}, {}
    for r in rows:
        key = (r["store"], r["table_name"], r["order_time"].date())
        private = any(w in r["table_name"] for w in P.PRIVATE_WORDS)
        mine = lines.get(r["order_no"], [])
        r["names"] = {x[3] for x in mine}
        pays = lambda x: {y for y in re.split(r"[,，、+/;；\s]+", x["pay_method"] or "") if y not in ("", "-")}
        text = lambda x: None if (x or "").strip() in ("", "-") else x.strip()
        if key not in state:
            state[key] = (r, r)
            out[r["order_no"]] = (r["order_no"], "first")
            continue
        anchor, prev = state[key]
        minutes = lambda a, b: (b - a).total_seconds() / 60
        gap = minutes(prev["order_time"], r["order_time"])
        since = minutes(anchor["order_time"], r["order_time"])
        small = r["revenue"] <= anchor["revenue"] * p.small_ratio or len(mine) <= p.small_line_cnt
        window = (p.window_hours_private if private else p.window_hours_regular) * 60
        reopen = p.reopen_min_private if private else p.reopen_min_regular
        out_gap = minutes(prev["checkout_time"], r["order_time"]) if prev["checkout_time"] else -1
        both = r["names"] | anchor["names"]
        jaccard = len(r["names"] & anchor["names"]) / len(both) if both else 0
        phone, other = text(r["member_phone"]), text(anchor["member_phone"])
        score = 20 + (25 if gap <= 30 else 10 if gap <= 60 else 0)
        if phone and other:
            score += 25 if phone == other else -10
        score += 15 if r["guests"] == anchor["guests"] else 0
        score += 5 if pays(r) & pays(anchor) else 0
        score += 10 if jaccard >= 0.1 else 0
        if small:
            score += p.small_bonus_low if r["revenue"] < 40 else p.small_bonus_mid if r["revenue"] < 60 else p.small_bonus_high
        score += 5 if text(r["remark"]) and text(r["remark"]) == text(anchor["remark"]) else 0
        if gap < p.concurrent_minutes:
            decision = "R0"
        elif since > window and not small:
            decision = "R1"
        elif r["revenue"] > anchor["revenue"] * p.add_on_max_ratio and anchor["revenue"] > p.anchor_min_amount:
            decision = "R2"
        elif out_gap > reopen and not small:
            decision = "R3"
        elif (
            private and p.dinner_start_hour <= r["order_time"].hour < p.dinner_end_hour
            and mine and all(x[4] in P.DRINK_CATEGORIES for x in mine)
        ):
            decision = "R3.5"
        else:
            decision = "score_merge" if score >= p.score_threshold else "score_split"
        joins = decision in ("R0", "R3.5", "score_merge")
        out[r["order_no"]] = (out[anchor["order_no"]][0] if joins else r["order_no"], decision)
        state[key] = (anchor if joins else r, r)
    return out


def merged(spark, orders, items, p=MergeParams()):
    o, i = frames(spark, orders, items)
    return {r["order_no"]: (r["group_id"], r["decision"]) for r in S.session_merge(o, i, p).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_equals_loop_on_random_input(spark, seed):
    orders, items = random_case(seed)
    assert merged(spark, orders, items) == loop_merge(orders, items)


def test_equals_loop_under_other_parameters(spark):
    p = MergeParams(concurrent_minutes=7, window_hours_regular=1, score_threshold=75, small_line_cnt=1, add_on_max_ratio=Decimal("0.9"))
    orders, items = random_case(99, 150)
    assert merged(spark, orders, items, p) == loop_merge(orders, items, p)


def test_row_order_does_not_matter(spark):
    orders, items = random_case(7)
    before = merged(spark, orders, items)
    random.Random(1).shuffle(orders)
    random.Random(2).shuffle(items)
    assert merged(spark, orders, items) == before


def test_every_order_is_in_one_group_of_its_table(spark):
    orders, items = random_case(11)
    o, i = frames(spark, orders, items)
    out = S.session_merge(o, i)
    assert out.count() == len(orders)
    spans = out.groupBy("group_id").agg(F.countDistinct("table_name", "biz_date").alias("n"))
    assert spans.filter("n > 1").count() == 0


def decisions(spark, orders, items=()):
    items = list(items) or items_of("none", ["x"])
    return {k: v[1] for k, v in merged(spark, orders, items).items()}


BIG = ["a", "b", "c", "d"]


def test_gap_of_exactly_five_minutes_is_not_concurrent(spark):
    near = decisions(spark, [order(1, 700, 500), order(2, 704.99, 500)])
    assert near["2"] == "R0"
    edge = decisions(spark, [order(1, 700, 500), order(2, 705, 500)], items_of(2, BIG))
    assert edge["2"] == "R2"


def test_window_is_longer_in_private_rooms_and_spares_small_orders(spark):
    lines = items_of(2, BIG) + items_of(4, BIG) + items_of(6, ["a"])
    out = decisions(
        spark,
        [
            order(1, 600, 300, "大厅1"), order(2, 600 + 121, 120, "大厅1"),
            order(3, 600, 300, "包间1"), order(4, 600 + 121, 120, "包间1"),
            order(5, 600, 300, "大厅2"), order(6, 600 + 121, 120, "大厅2"),
        ],
        lines,
    )
    assert out["2"] == "R1"
    assert out["4"] != "R1"
    assert out["6"] != "R1"


def test_amount_cap_does_not_apply_to_small_anchors(spark):
    out = decisions(
        spark,
        [order(1, 600, 20, "大厅1"), order(2, 610, 300, "大厅1"), order(3, 600, "20.01", "大厅2"), order(4, 610, 300, "大厅2")],
        items_of(2, BIG) + items_of(4, BIG),
    )
    assert out["2"] != "R2"
    assert out["4"] == "R2"


def test_drinks_after_dinner_in_a_private_room_stay(spark):
    late = [order(1, 17 * 60, 1000, "包间1", checkout=18 * 60), order(2, 19 * 60 + 30, 400, "包间1")]
    drinks = items_of(2, BIG, category="啤酒")
    assert decisions(spark, late, drinks)["2"] == "R3.5"
    assert decisions(spark, late, items_of(2, BIG))["2"] != "R3.5"


def test_hot_table_day(spark):
    """One table-day with nearly all orders: bounded slots, one plan for any size, same result as the loop."""
    rnd = random.Random(3)
    orders = [order(i, 600 + rnd.random() * 200, rnd.choice([20, 40, 90]), "大厅1") for i in range(1500)]
    orders += [order(5000 + i, 600 + rnd.random() * 10, 30, "大厅2") for i in range(400)]
    items = [row for i in range(0, 1500, 7) for row in items_of(i, ["a", "b", "c"])]
    o, i = frames(spark, orders, items)
    slots = S.build_slots(S.prepare_orders(o, i))
    assert slots.groupBy("table_name").count().agg(F.max("count")).first()[0] <= 288
    assert merged(spark, orders, items) == loop_merge(orders, items)


def test_slots_are_combined_before_the_shuffle(spark):
    o, i = frames(spark, *random_case(1))
    plan = S.build_slots(S.prepare_orders(o, i))._jdf.queryExecution().toString()
    assert "partial_min" in plan and "partial_max" in plan


def test_groups_from_stored_rows_equal_direct_groups(spark):
    o, i = frames(spark, *random_case(21))
    direct = G.aggregate_groups(o, i)
    stored = G.groups_from_merged(S.session_merge(o, i, features=True))
    cols = sorted(set(direct.columns))
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert key(direct) == key(stored)


def test_group_facts(spark):
    orders = [
        order(1, 600, 100, guests=2, opener="甲"), order(2, 602, 300, guests=5, opener="乙"),
        order(3, 603, 0, guests=9), order(4, 600, 0, "大厅9"),
    ]
    o, i = frames(spark, orders, items_of(1, ["a"]) + items_of(2, ["b", "c"]) + items_of(3, ["z"]))
    rows = G.aggregate_groups(o, i).collect()
    assert len(rows) == 1  # the group of free orders only is gone
    g = rows[0]
    assert (g["revenue"], g["guests"], g["item_count"], g["n_orders"], g["opener"]) == (400, 5, 3, 2, "甲")
    assert g["per_capita"] == Decimal("80.00")


@pytest.mark.parametrize(
    "rows,lines,status",
    [
        (dict(guests=0), ["a"], "no_per_capita"),
        (dict(), [("p", "对外售卖零食")], "snack"),
        (dict(), [("打包盒", "汤")], "packing"),
        (dict(guests=1, revenue=99), ["a"], "stray"),
        (dict(guests=1, revenue=100), ["a"], "kept"),
        (dict(table="吧台1"), ["a", "b"], "bar"),
        (dict(), ["a", "b"], "kept"),
    ],
)
def test_filter_status(spark, rows, lines, status):
    kw = dict(rows)
    o = [order(1, 600, kw.pop("revenue", 150), kw.pop("table", "大厅1"), **kw)]
    items = []
    for j, line in enumerate(lines):
        name, category = line if isinstance(line, tuple) else (line, "炒菜")
        items += [r[:1] + (j + 1,) + r[2:] for r in items_of(1, [name], category)]
    of, itf = frames(spark, o, items)
    assert G.aggregate_groups(of, itf).first()["filter_status"] == status


def test_funnel_adds_up(spark):
    orders, items = random_case(5, 200)
    orders += [order(900 + i, 700, 50, "外点自取") for i in range(4)] + [order(950, 700, 60, order_type="外带")]
    orders += [order(960, 700, 10), order(961, 700, 10, order_time=None), order(962, 700, 10), order(963, 700, 10)]
    o, i = frames(spark, orders, items)
    number = F.when(F.col("order_no") == "962", "x962").when(F.col("order_no") == "963", "963\n").otherwise(F.col("order_no"))
    o = o.withColumn("order_no", number).withColumn("revenue", F.when(F.col("order_no") != "960", F.col("revenue")))
    f = G.order_count_funnel(o, G.groups_of(o, i), ["store"]).first().asDict()
    assert f["raw_orders"] - f["takeaway_orders"] - f["not_dine_in_orders"] - f["invalid_orders"] - f["free_orders"] - f["merged_away"] == f["merged_groups"]
    dropped = sum(f[c] for c in ("no_per_capita_groups", "snack_groups", "packing_groups", "stray_groups", "bar_groups"))
    assert f["merged_groups"] - dropped == f["counted_groups"]
    assert (f["takeaway_orders"], f["not_dine_in_orders"], f["invalid_orders"]) == (4, 1, 4)


def test_orders_without_table_or_time(spark):
    orders = [order(1, 600, 50, None), order(2, 602, 20, None), order(3, 600, 50, order_time=None), order(4, 600, 50, store=None)]
    o, i = frames(spark, orders, items_of(1, ["a"]))
    out = {r["order_no"]: r["group_id"] for r in S.session_merge(o, i).collect()}
    assert out == {"1": "1", "2": "1", "4": "4"}
    assert sorted(r["group_id"] for r in G.aggregate_groups(o, i).collect()) == ["1", "4"]


def test_every_order_is_explained(spark):
    """One row per order with the group and decision of the merge; R0 and first orders have no rule values."""
    o, i = frames(spark, *random_case(5))
    clean = o.filter("order_type = '堂食'")
    told = S.merge_explain(clean, i).collect()
    merged = {r["order_no"]: (r["group_id"], r["decision"]) for r in S.session_merge(clean, i).collect()}
    assert {r["order_no"]: (r["group_id"], r["decision"]) for r in told} == merged and len(told) == len(merged)
    for r in told:
        early = r["decision"] in ("first", "R0")
        assert (r["score"] is None) == early and (not early or r["anchor_no"] == r["group_id"])


def test_labels_of_orders_need_no_statistics_of_slots(spark):
    """Sums, openers and members of slots were folded and sent along, though only the group and the decision are read."""
    o, i = frames(spark, *random_case(3))
    plan = S.session_merge(o, i)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_all" not in plan and "top_order" not in plan and "first_opener" not in plan
