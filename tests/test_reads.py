"""What registered queries read and write beside their results."""

from __future__ import annotations

import re


from pyspark.sql import functions as F

from dinefold.operators import sessions as S
from dinefold.plans import periods as PL
from dinefold.plans import precheck, roles
from tests.helpers import frames, items_of, order

SF = "/root/testdata/sf0.001"


def written(monkeypatch, *modules):
    seen = []
    for m in modules:
        real = m.stored
        monkeypatch.setattr(m, "stored", lambda df, purpose, real=real: seen.append((purpose, df)) or real(df, purpose))
    return seen


def test_reports_without_groups_write_nothing_and_merge_nothing(spark, monkeypatch):
    """The whole history of both years was loaded before for each of them."""
    from dinefold.plans import merge

    seen = written(monkeypatch, PL, merge, S)
    for fn in (PL.category_distribution, PL.revenue_closure, precheck.precheck_history):
        fn(spark, SF).collect()
    assert not [p for p, _ in seen if p in ("week-orders", "week-lines", "merged", "prepared")]


def test_period_reports_merge_the_compared_days_alone(spark):
    days = {r[0] for r in PL.week_orders(spark, SF).select("biz_date").distinct().collect()}
    assert days and all(any(a <= d <= b for a, b in PL.WEEK.bounds.values()) for d in days)


def test_lines_of_orders_of_both_years(spark):
    orders = PL.history(spark, SF).select("order_no")
    got = roles.items_of_orders(spark, SF, orders)
    both = roles.items(spark, SF).withColumn(
        "order_no", F.explode(F.array("order_no", (F.col("order_no").cast("bigint") + roles.LAST_YEAR_ID).cast("string")))
    ).join(orders, "order_no")
    assert got.count() == both.count() > 0 and got.exceptAll(both.select(*got.columns)).count() == 0


def test_a_merge_with_features_groups_the_lines_once(spark, monkeypatch):
    calls = []
    real = S.order_features
    monkeypatch.setattr(S, "order_features", lambda items: calls.append(1) or real(items))
    seen = written(monkeypatch, S)
    orders, items = frames(spark, [order(1, 600), order(2, 603), order(3, 800)], items_of(1, ["a"]) + items_of(3, ["b"]))
    got = S.session_merge(orders, items, features=True)
    assert {r["order_no"]: (r["group_id"], r["line_cnt"]) for r in got.collect()} == {"1": ("1", 1), "2": ("1", 0), "3": ("3", 1)}
    assert len(calls) == 1 and [p for p, _ in seen] == ["prepared"]
    assert "collect_set" not in re.sub(r"\s+", " ", got._jdf.queryExecution().toString())
