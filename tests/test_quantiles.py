"""Order statistics by narrowing against sorted lists."""

import random

import pytest

from dinefold.operators import quantiles as Q


@pytest.mark.parametrize("widths", [Q.WIDTHS, (120, 8, 1)])
def test_marks_equal_sorted_values(spark, widths):
    rnd = random.Random(2)
    rows = []
    for store, n, top in (("a", 400, 5), ("b", 1, 9), ("c", 300, 10**9), (None, 51, 200_000_000), ("e", 2, 300)):
        rows += [(store, rnd.randrange(-top, top), rnd.randrange(1, 4)) for _ in range(n)]
    rows += [("d", None, 3), ("c", None, 5), ("f", 8, 0)]
    df = spark.createDataFrame(rows, "store string, value long, n long").repartition(3)
    got = {r["store"]: (r["low"], r["mid"], r["high"], r["top"]) for r in Q.marks(df, ["store"], {"low": 0.0, "mid": 0.5, "high": 0.9, "top": 1.0}, widths).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for store in got:
        values = sorted(v for s, v, n in rows if s == store and v is not None for _ in range(n))
        for q, mark in zip((0.0, 0.5, 0.9, 1.0), got[store]):
            at = q * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert mark == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-6)


def test_widths_divide_each_other():
    with pytest.raises(ValueError):
        Q.values_at(None, None, [], (100, 7, 1))


def test_no_percentile_state_and_no_pairs(spark):
    df = spark.createDataFrame([("a", 1, 1)], "store string, value long, n long")
    plan = Q.marks(df, ["store"], {"mid": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
