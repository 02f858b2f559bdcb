"""Small order and item tables for tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

ORDER = (
    "order_no string, store string, order_time timestamp_ntz, checkout_time timestamp_ntz, amount decimal(18,2), "
    "revenue decimal(18,2), guests int, order_type string, table_name string, member_phone string, member_name string, "
    "pay_method string, remark string, opener string"
)
ITEM = (
    "order_no string, seq int, sku string, name string, category string, spec string, sale_type string, "
    "unit_price decimal(18,2), qty decimal(18,2), line_amount decimal(18,2), item_revenue decimal(18,2)"
)
DAY = datetime(2024, 3, 4)


def order(no, minute, revenue=100, table="大厅1", checkout=None, guests=2, **kw):
    t = DAY + timedelta(minutes=minute)
    out = DAY + timedelta(minutes=checkout) if checkout is not None else None
    row = dict(
        order_no=str(no), store="万荷店", order_time=t, checkout_time=out, amount=Decimal(str(revenue)),
        revenue=Decimal(str(revenue)), guests=guests, order_type="堂食", table_name=table, member_phone="-",
        member_name="-", pay_method="-", remark="", opener="甲",
    )
    row.update(kw)
    return tuple(row[c.split()[0]] for c in ORDER.split(", "))


def items_of(no, names, category="炒菜", revenue=10):
    return [
        (str(no), i + 1, f"S{n}", n, category, None, "单品", None, Decimal(1), Decimal(revenue), Decimal(revenue))
        for i, n in enumerate(names)
    ]


def frames(spark, orders, items):
    return spark.createDataFrame(orders, ORDER), spark.createDataFrame(items, ITEM)


def random_case(seed: int, n: int = 120):
    """Orders of a few tables on two days, close enough in time for all rules to fire."""
    rnd = random.Random(seed)
    orders, items = [], []
    for i in range(n):
        minute = rnd.choice([rnd.randrange(600, 900), rnd.randrange(1000, 1439), rnd.randrange(1440 + 600, 1440 + 900)])
        table = rnd.choice(["大厅1", "大厅2", "包间8", "包间9"])
        orders.append(
            order(
                i, minute + rnd.random() * 0.9, rnd.choice([0, 8, 19, 35, 45, 59, 80, 120, 300]), table,
                checkout=None if rnd.random() < 0.2 else minute + rnd.randrange(1, 100), guests=rnd.randrange(1, 5),
                member_phone=rnd.choice(["-", "138", "139", ""]), pay_method=rnd.choice(["-", "微信", "微信+会员卡", "现金"]),
                remark=rnd.choice(["", "少辣", "不辣"]), member_name=rnd.choice(["-", "王", None]),
            )
        )
        names = rnd.sample(["a", "b", "c", "d", "e", "f", "g"], rnd.randrange(0, 6))
        for row in items_of(i, names):
            items.append(row[:4] + (rnd.choice(["啤酒", "茶"]) if rnd.random() < 0.7 else "炒菜",) + row[5:])
    return orders, items
