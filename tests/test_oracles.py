"""Every registered query against its SQL oracle, on the smallest data."""

from __future__ import annotations

import os

import pytest

from dinefold.plans import all_oracles, all_queries
from tests.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_oracle(spark, con, name):
    assert compare(all_queries()[name](spark, SF), con, all_oracles()[name]) == []


def test_corrected_guests_reach_the_totals(spark):
    """Revenue stays, guests and per-capita follow the visits."""
    totals = {
        name: {r["store"]: r for r in all_queries()[name](spark, SF).where("daypart = '全部' and area = '全部'").collect()}
        for name in ("overview", "corrected_overview")
    }
    plain, fixed = totals["overview"], totals["corrected_overview"]
    assert set(plain) == set(fixed) and all(plain[s]["revenue"] == fixed[s]["revenue"] for s in plain)
    assert any(plain[s]["guests"] != fixed[s]["guests"] and plain[s]["per_capita"] != fixed[s]["per_capita"] for s in plain)
