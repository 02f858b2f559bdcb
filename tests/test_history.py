"""The stored history: any sequence of loads equals one load, and a load touches only what it changes."""

from __future__ import annotations

import os
import random
import shutil
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dinefold.operators import groups as G
from dinefold.operators import sessions as S
from dinefold.operators.periods import Period, in_period
from dinefold.sources.history import LINE_MARTS, MARTS, PART, History, line_mart
from tests.helpers import DAY, ITEM, ORDER, frames, items_of, order, random_case


def rows(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def files(path):
    """Every data file with the time it was written, by its partition."""
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                full = os.path.join(folder, n)
                out.setdefault(os.path.relpath(folder, path), set()).add((n, os.stat(full).st_mtime_ns))
    return out


def equals_one_load(spark, history, orders, items):
    """The tables against the batch operators over all orders."""
    merged = S.session_merge(orders, items, features=True)
    got = history.table("orders").drop("digest")
    assert rows(got) == rows(merged.select(*got.columns))
    groups = G.aggregate_groups(orders, items)
    stored = history.table("groups")
    assert rows(stored) == rows(groups.select(*stored.columns))
    counted = merged.filter("revenue > 0").join(G.kept(groups).select("group_id"), "group_id", "left_semi")
    lines = history.table("items")
    assert rows(lines.select(*items.columns)) == rows(items.join(merged.select("order_no"), "order_no", "left_semi"))
    assert rows(lines.filter("counted").select("order_no", "seq", "group_id", "biz_date")) == rows(
        items.join(counted, "order_no").select("order_no", "seq", "group_id", "biz_date")
    )
    for name, mart in MARTS.items():
        stored = history.table(name)
        assert rows(stored) == rows(mart(G.kept(groups)).select(*stored.columns)), name
    of = items.join(counted.select("order_no", "group_id", "biz_date", "store"), "order_no").withColumn("counted", F.lit(True))
    for name in LINE_MARTS:
        stored = history.table(name)
        assert rows(stored) == rows(line_mart(name, of).select(*stored.columns)), name


def test_many_loads_equal_one(spark, tmp_path):
    rnd = random.Random(1)
    orders, items = random_case(1, 90)
    stores = ["万荷店", "001", ""]
    orders = [(o[0], stores[i % 3], *o[2:]) for i, o in enumerate(orders)]
    history = History(spark, str(tmp_path / "h"))
    fields = [c.split()[0] for c in ORDER.split(", ")]
    at = {n: i for i, n in enumerate(fields)}
    state, lines = {}, {}
    batches = [orders[:40], orders[30:70], orders[60:]]
    for k, batch in enumerate(batches):
        batch = [list(o) for o in batch]
        for o in batch:
            if k and rnd.random() < 0.3:  # a corrected order: another amount, table, or day
                o[at["revenue"]] = Decimal(rnd.choice([0, 15, 200]))
                o[at["table_name"]] = rnd.choice(["大厅1", "包间8"])
                o[at["order_time"]] += timedelta(days=rnd.choice([0, 0, 1]))
        batch = [tuple(o) for o in batch]
        own = {o[0]: [r for r in items if r[0] == o[0] and (not k or rnd.random() < 0.9)] for o in batch}
        o, i = frames(spark, batch, [r for rs in own.values() for r in rs])
        history.load(o.repartition(3), i)
        state |= {o[0]: o for o in batch}
        lines |= own
    equals_one_load(spark, history, *frames(spark, list(state.values()), [r for rs in lines.values() for r in rs]))


ORDERS = [order(f"{d}{i:02}", d * 1440 + 700 + 7 * i, 100 + i, f"大厅{i % 4}") for d in range(3) for i in range(24)]
ORDERS = [(o[0], "万荷店" if int(o[0]) % 2 else "保利店", *o[2:]) for o in ORDERS]
ITEMS = [r for o in ORDERS for r in items_of(o[0], ["a", "b", "c"])]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    history = History(spark, str(tmp_path_factory.mktemp("history") / "h"))
    # Even tables of one store and odd ones of the other, on three days.
    assert history.load(*frames(spark, ORDERS, ITEMS)).count() == 12
    return history.path


@pytest.fixture
def sample(spark, tmp_path, loaded):
    return History(spark, shutil.copytree(loaded, str(tmp_path / "h"))), ORDERS, ITEMS


def test_a_load_without_news_writes_nothing(spark, sample):
    history, orders, items = sample
    before = files(history.path)
    shuffled = random.Random(1).sample(items, len(items))
    assert history.load(*frames(spark, orders[::-1], shuffled)).count() == 0
    assert history.load(*frames(spark, orders[5:9], [r for o in orders[5:9] for r in items if r[0] == o[0]])).count() == 0
    assert files(history.path) == before


def test_one_order_rewrites_one_partition_of_each_table(spark, sample):
    history, orders, items = sample
    before = files(history.path)
    new = (order("777", 1440 + 715, 90, "大厅1"),)
    days = history.load(*frames(spark, list(new), items_of("777", ["d"]))).collect()
    assert [(r["table_name"], r["biz_date"]) for r in days] == [("大厅1", date(2024, 3, 5))]
    after = files(history.path)
    assert {p.split("/", 1)[1] for p in after if after[p] != before.get(p)} == {"biz_date=2024-03-05/store=万荷店"}
    equals_one_load(spark, history, *frames(spark, [*orders, *new], [*items, *items_of("777", ["d"])]))


def test_a_changed_line_is_news(spark, sample):
    history, orders, items = sample
    o = orders[30]
    lines = [r[:-1] + (Decimal(99),) for r in items if r[0] == o[0]]
    assert history.load(*frames(spark, [o], lines)).count() == 1
    equals_one_load(spark, history, *frames(spark, orders, [r for r in items if r[0] != o[0]] + lines))


def test_a_day_that_loses_its_last_order_goes(spark, tmp_path):
    alone = order("1", 700, 100)
    history = History(spark, str(tmp_path / "h"))
    history.load(*frames(spark, [alone, order("2", 2200, 50)], items_of("1", ["a"]) + items_of("2", ["b"])))
    later = order("1", 700 + 1440, 100)
    assert history.load(*frames(spark, [later], items_of("1", ["a"]))).count() == 2
    assert history.table("orders").select(*PART).distinct().count() == 1
    equals_one_load(spark, history, *frames(spark, [later, order("2", 2200, 50)], items_of("1", ["a"]) + items_of("2", ["b"])))


def test_a_load_that_broke_off_is_done_again(spark, sample, monkeypatch):
    history, orders, items = sample
    new, lines = [order("888", 720, 60, "大厅1")], items_of("888", ["x"])
    replace = History._replace

    def fails(self, name, df, parts):
        if name == "orders":
            raise RuntimeError("lost")
        replace(self, name, df, parts)

    monkeypatch.setattr(History, "_replace", fails)
    with pytest.raises(RuntimeError):
        history.load(*frames(spark, new, lines))
    monkeypatch.setattr(History, "_replace", replace)
    assert history.load(*frames(spark, new, lines)).count() == 1
    equals_one_load(spark, history, *frames(spark, orders + new, items + lines))


def test_a_week_reads_a_week(spark, tmp_path):
    orders = [order(i, 1440 * i + 700) for i in range(30)]
    history = History(spark, str(tmp_path / "h"))
    history.load(*frames(spark, orders, [r for i in range(30) for r in items_of(i, ["a"])]))
    week = in_period(history.table("items"), "biz_date", Period("week", date(2024, 3, 18)))
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "biz_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f for f in week.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(read) == 14 and DAY.day == 4


def test_no_orders_at_all(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"))
    empty = spark.createDataFrame([], ORDER), spark.createDataFrame([], ITEM)
    assert history.load(*empty).count() == 0 and not history.exists()
    assert history.load(*frames(spark, [order("1", 10, 5)], [])).count() == 1
    assert history.load(*empty).count() == 0 and history.table("orders").count() == 1


def test_a_history_older_than_its_drink_marts(spark, tmp_path):
    orders = [order(str(i), 700 + 1440 * i, 100) for i in range(3)]
    items = [r for i in range(3) for r in items_of(str(i), ["a"], category="啤酒")]
    history = History(spark, str(tmp_path / "h"))
    history.load(*frames(spark, orders[:2], items[:2]))
    for name in LINE_MARTS:
        shutil.rmtree(tmp_path / "h" / name)
        assert history.table(name).count() == 2
    history.load(*frames(spark, orders[2:], items[2:]))
    assert history._whole("daily_drinks") and history._filled("daily_drinks")
    equals_one_load(spark, history, *frames(spark, orders, items))
