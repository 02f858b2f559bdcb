"""Visit matching against brute force over all pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest

from dinefold.operators import visits as V
from tests.helpers import ORDER, order

VISIT = (
    "visit_id bigint, order_no string, store string, table_name string, guests int, paid decimal(18,2), order_time timestamp_ntz, "
    "waiter string, member_status string, transcript string, satisfaction double, created_at timestamp_ntz"
)
FIELDS = [c.split()[0] for c in ORDER.split(", ")]
DAY = datetime(2024, 3, 4)


def yuan(x):
    return int(x.quantize(Decimal(1), ROUND_HALF_UP))


def brute(visits, orders):
    rows = [dict(zip(FIELDS, o)) for o in orders]
    known = {r["order_no"] for r in rows}
    out = {}
    for v in visits:
        vid, no, store, table, _, paid, t, *_, created = v
        if no in known:
            continue
        best = None
        for r in rows:
            if r["store"] != store:
                continue
            diff = abs((t - r["order_time"]) // timedelta(microseconds=1)) if t else None
            c_time = diff is not None and diff <= 300_000_000
            c_table = bool(table) and table in r["table_name"]
            c_amount = yuan(paid) in (yuan(r["amount"]), yuan(r["revenue"]))
            n = c_time + c_table + c_amount
            if n < 2 or not (c_time or (t or created).date() == r["order_time"].date()):
                continue
            rank = (-n, diff if diff is not None else 2**62, r["order_no"])
            best = min(best, rank) if best else rank
        if best:
            out[vid] = (best[2], -best[0])
    return out


def make(seed, n_orders, n_visits, amounts, tables, minutes):
    rnd = random.Random(seed)
    orders = []
    for i in range(n_orders):
        o = list(order(f"{i}", rnd.choice(minutes) + rnd.random(), rnd.choice(amounts), "大厅B区" + rnd.choice(tables)))
        o[FIELDS.index("amount")] = o[FIELDS.index("revenue")] + rnd.choice([0, 3])
        orders.append(tuple(o))
    visits = []
    for i in range(n_visits):
        t = DAY + timedelta(minutes=rnd.choice(minutes) + rnd.random() * 4) if rnd.random() > 0.2 else None
        visits.append((
            i, rnd.choice([None, "", "-", "nope", "3"]), "万荷店", rnd.choice([*tables, "Z", None, ""]), 2,
            Decimal(rnd.choice(amounts)) + rnd.choice([Decimal("0"), Decimal("0.4"), Decimal("3")]), t, "w", "", None, 5.0,
            DAY + timedelta(minutes=rnd.choice(minutes)),
        ))
    return visits, orders


CASES = [
    (1, 80, 80, ["20.5", "20.49", "35", "80"], ["B07", "B0", "A1"], range(600, 700)),
    # A hot amount and table, and days that meet at midnight.
    (2, 150, 60, ["50"], ["B07", "B08"], range(700, 720)),
    (3, 60, 60, ["20", "30"], ["A1", "A2"], [*range(1430, 1440), *range(1440, 1450)]),
]


@pytest.mark.parametrize("case", CASES, ids=["mixed", "hot", "midnight"])
def test_two_of_three(spark, case):
    visits, orders = make(*case)
    v, o = spark.createDataFrame(visits, VISIT), spark.createDataFrame(orders, ORDER)
    got = {r["visit_id"]: (r["order_no"], r["n_conditions"]) for r in V.visit_two_of_three(v, o).collect()}
    assert got == brute(visits, orders)


def test_names_are_found_by_their_rarest_part(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab大1") for _ in range(n))
    orders = {(rnd.choice("XY"), word(rnd.randrange(0, 9))) for _ in range(60)} | {("X", None)}
    visits = {(rnd.choice("XY"), word(rnd.randrange(0, 6))) for _ in range(80)} | {("Y", None)}
    got = V.table_names_within(spark.createDataFrame(list(visits), "store string, visit_table string"), spark.createDataFrame(list(orders), "store string, order_table string"))
    want = {(s, v, o) for s, v in visits for t, o in orders if s == t and v and o and v in o}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_a_hot_slot_is_read_in_order(spark):
    """Ten thousand orders of one amount in one slot, and a table text that every table holds."""
    n = 10_000
    orders = spark.range(n).selectExpr(
        "cast(id as string) as order_no", "'万荷店' as store", "timestamp_ntz'2024-03-04 12:00:00' + make_dt_interval(0, 0, 0, id * 0.029) as order_time",
        "cast(50 as decimal(18,2)) as amount", "cast(50 as decimal(18,2)) as revenue", "concat('大厅', id % 7) as table_name",
    )
    visits = spark.range(400).selectExpr(
        "id as visit_id", "cast(null as string) as order_no", "'万荷店' as store", "'大' as table_name", "cast(if(id % 2 = 0, 50, 9) as decimal(18,2)) as paid",
        "timestamp_ntz'2024-03-04 12:00:00' + make_dt_interval(0, 0, 0, id * 0.7 + 0.001) as order_time", "timestamp_ntz'2024-03-04 12:00:00' as created_at",
    )
    got = {r["visit_id"]: (r["order_no"], r["n_conditions"], r["diff_us"]) for r in V.visit_two_of_three(visits, orders).collect()}
    for i in range(400):
        t = i * 700_000 + 1000
        diff, no = min((abs(k * 29_000 - t), str(k)) for k in range(max(0, t // 29_000 - 1), min(n, t // 29_000 + 3)))
        assert got[i] == (no, 3 if i % 2 == 0 else 2, diff)
    plan = V.visit_two_of_three(visits, orders)._jdf.queryExecution().analyzed().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_slots_meet_at_their_ends(spark):
    """Orders on both sides of the ends of slots and days, several of one moment, and many visits in a row."""
    rnd = random.Random(7)
    minutes = [30 * k + d for k in range(44, 52) for d in (-5, -4, -1, 0, 1, 4)]
    visits, orders = make(7, 150, 300, ["20", "30"], ["A1", "A2"], minutes)
    time = FIELDS.index("order_time")
    orders = [o[:time] + (o[time].replace(second=rnd.choice([0, 30]), microsecond=0),) + o[time + 1 :] for o in orders]
    visits = [v[:6] + (v[6] and v[6].replace(second=rnd.choice([0, 30]), microsecond=0),) + v[7:] for v in visits]
    v, o = spark.createDataFrame(visits, VISIT), spark.createDataFrame(orders, ORDER)
    got = {r["visit_id"]: (r["order_no"], r["n_conditions"]) for r in V.visit_two_of_three(v, o).collect()}
    assert got == brute(visits, orders) and len(got) > 100


def test_orders_are_dealt_out_once(spark):
    """An order is one row per key; before, ends of slots and days were found by sorting and were three rows more per key."""
    visits, orders = make(8, 40, 40, ["20", "30"], ["A1", "A2"], range(600, 700))
    plan = V.visit_two_of_three(spark.createDataFrame(visits, VISIT), spark.createDataFrame(orders, ORDER))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(o_us" not in text and "max(struct(o_us" not in text
    o = spark.range(10).selectExpr(
        "cast(id as string) as order_no", "'X' as store", "'T' as order_table", "id * 60000000 as o_us", "id as yuan", "if(id < 5, id, id + 1) as other_yuan"
    )
    # By table; by amount, and by both, where a second amount is another one.
    assert V._order_points(o).count() == 10 + 2 * (10 + 5)


def test_a_short_text_asks_only_tables_with_orders_near(spark, monkeypatch):
    """A text that 300 tables hold, one order each over twenty days; before, each visit asked all 300, by slot and by day."""
    rnd = random.Random(9)
    orders = []
    for i in range(300):
        o = list(order(f"{i}", i * 96 + rnd.random(), rnd.choice(["20", "30", "40"]), f"大厅{i}"))
        o[FIELDS.index("amount")] = o[FIELDS.index("revenue")] + rnd.choice([0, 3])
        orders.append(tuple(o))
    visits = []
    for i in range(120):
        at = DAY + timedelta(minutes=rnd.randrange(300) * 96 + rnd.uniform(-6, 7))
        visits.append((
            i, None, "万荷店", rnd.choice(["大", "厅", "1", "29"]), 2, Decimal(rnd.choice(["20", "33", "9"])), at if i % 4 else None, "w", "", None, 5.0, at,
        ))
    asked, nearest = [], V._nearest
    monkeypatch.setattr(V, "_nearest", lambda rows, points: asked.append(rows.count()) or nearest(rows, points))
    v, o = spark.createDataFrame(visits, VISIT), spark.createDataFrame(orders, ORDER)
    got = {r["visit_id"]: (r["order_no"], r["n_conditions"]) for r in V.visit_two_of_three(v, o).collect()}
    assert got == brute(visits, orders) and len(got) > 60
    assert asked[0] < 10 * len(visits)


def test_marks_hold_every_order_of_a_table(spark):
    """More slots and amounts than a table has bits: no order is missed when all of them are set."""
    rnd = random.Random(10)
    orders = []
    for i in range(2500):
        o = list(order(f"{i}", i * 29 + rnd.random(), str(rnd.randrange(20, 60)), "大厅A1"))
        o[FIELDS.index("amount")] = o[FIELDS.index("revenue")] + rnd.choice([0, 3])
        orders.append(tuple(o))
    visits = []
    for i in range(80):
        at = DAY + timedelta(minutes=rnd.randrange(2500) * 29 + rnd.uniform(-6, 7))
        visits.append((i, None, "万荷店", "A", 2, Decimal(rnd.randrange(20, 60)), at if i % 4 else None, "w", "", None, 5.0, at))
    v, o = spark.createDataFrame(visits, VISIT), spark.createDataFrame(orders, ORDER)
    got = {r["visit_id"]: (r["order_no"], r["n_conditions"]) for r in V.visit_two_of_three(v, o).collect()}
    assert got == brute(visits, orders) and len(got) > 50


def test_every_visit_is_matched_or_listed(spark):
    visits, orders = make(4, 50, 70, ["20", "35"], ["B07", "A1"], range(600, 660))
    v, o = spark.createDataFrame(visits, VISIT), spark.createDataFrame(orders, ORDER)
    m = V.match_visits(v, o)
    assert m.count() + V.visit_unmatched(v, m).count() == len(visits)
    assert m.select("visit_id").distinct().count() == m.count()


def test_guest_correction(spark):
    groups = spark.createDataFrame([("g1", 2, Decimal("100.00")), ("g2", 3, Decimal("90.00"))], "group_id string, guests int, revenue decimal(18,2)")
    linked = spark.createDataFrame(
        [("g1", 1, 3, DAY), ("g1", 2, 4, DAY + timedelta(hours=1)), ("g2", 3, 0, DAY)],
        "group_id string, visit_id bigint, visit_guests int, created_at timestamp_ntz",
    )
    out = {r["group_id"]: (r["guests"], r["guests_corrected"], r["per_capita"]) for r in V.guest_correction(groups, linked).collect()}
    assert out == {"g1": (4, True, Decimal("25.00")), "g2": (3, False, Decimal("30.00"))}
