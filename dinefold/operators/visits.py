"""Linking visit feedback to orders and groups.

Exact match by order number first; what is left may match an order on any two of table, amount and time. Two of
three always include the amount or the time, and only the order nearest in time can win per key, so both sides
are sorted together by time within a key, and each visit takes the last order before it and the first after it. Keys
are (store, amount) and (store, table), cut into half-hour slots, since what counts there is five minutes away at
most, and (store, amount, table), cut into days. An order lies in one slot; a visit near the end of a slot asks the
next one too, so that no ends of slots need to be found first. A hot amount or table is dealt out by time; orders of
one amount, table and day stay together, sorted on disk if need be. No visit meets an order pair by pair.

A short table text lies in many tables, most of which have no order at the time of the visit. So each table carries marks
of its half hours, and of its amounts by day, in a fixed number of bits; a visit asks a table only where the mark is
set. A mark may be another key's, which costs a row and changes nothing; no order is without its marks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions import business as B
from dinefold.functions.cells import real_text
from dinefold.session import stored

NEAR_US = P.VISIT_TIME_MINUTES * B.MINUTE_US
#: Wide enough that a visit rarely asks two of them; at least twice NEAR_US, or it could ask three.
SLOT_US = 6 * NEAR_US
DAY_US = 24 * 60 * B.MINUTE_US
#: Longest part of a table name in the index of names.
GRAM = 3
#: Words of 64 bits in which a table's slots are marked, and as many for its amounts by day.
WORDS = 16
#: What matching reads of an order.
ORDER_COLUMNS = ["order_no", "store", "table_name", "order_time", "amount", "revenue"]


def visit_exact_match(visits: DataFrame, orders: DataFrame) -> DataFrame:
    v = visits.withColumn("order_no", real_text(F.col("order_no")))
    return v.select("visit_id", "order_no").join(orders.select("order_no"), "order_no", "left_semi").select("visit_id", "order_no")


def _left_over(visits: DataFrame, orders: DataFrame) -> DataFrame:
    v = visits.withColumn("order_no", real_text(F.col("order_no")))
    return v.join(orders.select("order_no"), "order_no", "left_anti")


def _grams(name: Column, sizes: Column) -> Column:
    """The distinct parts of a name with the given numbers of characters."""
    return F.array_distinct(
        F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substring(name, i, k))))
    )


def table_names_within(visit_tables: DataFrame, order_tables: DataFrame) -> DataFrame:
    """Pairs (store, visit_table, order_table) where the order's table contains the visit's.

    Works on distinct names by an index of the parts of one to GRAM characters of the orders' tables. A
    visit's table is looked up by its rarest part only, then compared; one of up to GRAM characters is its own part.
    """
    sizes = F.sequence(F.lit(1), F.least(F.length("order_table"), F.lit(GRAM)))
    index = order_tables.filter(F.length("order_table") > 0).select("store", "order_table", F.explode(_grams(F.col("order_table"), sizes)).alias("gram"))
    spread = index.groupBy("store", "gram").agg(F.count(F.lit(1)).alias("names"))
    own = F.array(F.least(F.length("visit_table"), F.lit(GRAM)))
    parts = visit_tables.filter(F.length("visit_table") > 0).select("store", "visit_table", F.explode(_grams(F.col("visit_table"), own)).alias("gram"))
    # A part that no order's table has is the rarest of all.
    rank = F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")
    rarest = parts.join(spread, ["store", "gram"], "left").groupBy("store", "visit_table").agg(F.min(rank)["gram"].alias("gram"))
    return rarest.join(index, ["store", "gram"]).filter(F.col("order_table").contains(F.col("visit_table"))).select("store", "visit_table", "order_table")


def _stretch(t_us: Column, width: int) -> Column:
    return F.floor(t_us / F.lit(width)).cast("bigint")


#: What orders and visits are brought together by: an amount (no table), a table (no amount), or both, and the stretch of time.
KEY = ["store", "yuan", "order_table", "part"]


def _key(*parts: Column, yuan: Column | None = None, table: Column | None = None, marks: Column | None = None) -> list[Column]:
    """A key for each stretch of time, null where the amount, the table or the stretch it needs is missing, or its mark."""
    number, name = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    fields = [(number if yuan is None else yuan).alias("yuan"), (name if table is None else table).alias("order_table")]
    needed = [c.isNotNull() for c in (yuan, table) if c is not None]

    def met(part: Column) -> Column:
        found = reduce(and_, needed, part.isNotNull())
        return found if marks is None else found & _marked(marks, part, yuan)

    return [F.when(met(part), F.struct(*fields, part.alias("part"))) for part in parts]


def _mark(part: Column, yuan: Column | None) -> tuple[Column, Column]:
    """The word and the bit that mark a stretch of time, or an amount in it."""
    h = F.xxhash64(part) if yuan is None else F.xxhash64(part, yuan)
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))


def _marked(marks: Column, part: Column, yuan: Column | None) -> Column:
    word, bit = _mark(part, yuan)
    return F.get(marks, word).bitwiseAND(bit) != 0


def _marks(part: Column, *yuans: Column | None) -> Column:
    """Aggregate: the marks of all orders of a table."""
    each = [_mark(part, yuan) for yuan in yuans]

    def word(i: int) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(w == i, bit).otherwise(F.lit(0).cast("bigint")) for w, bit in each])

    return F.array(*[F.bit_or(word(i)) for i in range(WORDS)])


def _order_tables(orders: DataFrame) -> DataFrame:
    """(store, order_table, slot_marks, day_marks): one row per table, of a fixed size."""
    slot, day = _stretch(F.col("o_us"), SLOT_US), _stretch(F.col("o_us"), DAY_US)
    return orders.filter(F.length("order_table") > 0).groupBy("store", "order_table").agg(
        _marks(slot, None).alias("slot_marks"), _marks(day, F.col("yuan"), F.col("other_yuan")).alias("day_marks")
    )


def _with_tables(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Visits with each table of their store that contains their table's text, and its marks."""
    # Read for the names and for the marks.
    tables = stored(_order_tables(orders), "tables")
    names = table_names_within(visits.select("store", "visit_table").distinct(), tables.select("store", "order_table"))
    return visits.join(names.join(tables, ["store", "order_table"]), ["store", "visit_table"])


def _by_key(df: DataFrame, keys: list[Column], *row: str | Column) -> DataFrame:
    """A row for each key that is not null. Keys are dropped as rows: taking them out of the array would leave compiled code."""
    return df.select(*row, F.inline(F.array(*keys))).filter("part is not null")


def _order_points(orders: DataFrame) -> DataFrame:
    """(key, t, order_no): an order by each of its amounts, by its table, and by both."""
    slot, day, table = _stretch(F.col("o_us"), SLOT_US), _stretch(F.col("o_us"), DAY_US), F.col("order_table")
    amounts = (F.col("yuan"), F.when(~F.col("yuan").eqNullSafe(F.col("other_yuan")), F.col("other_yuan")))
    keys = _key(slot, table=table)
    for yuan in amounts:
        keys += _key(slot, yuan=yuan) + _key(day, yuan=yuan, table=table)
    return _by_key(orders, keys, "store", F.col("o_us").alias("t"), "order_no")


def _asked(visits: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, visit_id, t): the slots and days that orders near a visit lie in; one without a time asks the day of its entry."""
    v_us = F.col("v_us")
    first, last = v_us - NEAR_US, v_us + NEAR_US

    def stretches(width: int, others: Column) -> list[Column]:
        a, b = _stretch(first, width), _stretch(last, width)
        return [F.coalesce(a, others), F.when(a != b, b)]

    none = F.lit(None).cast("bigint")
    slots, days, yuan, table = stretches(SLOT_US, none), stretches(DAY_US, F.col("day")), F.col("yuan"), F.col("order_table")
    row = ["store", "visit_id", v_us.alias("t")]
    by_amount = _by_key(visits, _key(*slots, yuan=yuan), *row)
    keys = _key(*slots, table=table, marks=F.col("slot_marks")) + _key(*days, yuan=yuan, table=table, marks=F.col("day_marks"))
    # Most tables of a short text have no mark; they go before rows are made of them.
    by_table = _by_key(tables.filter(reduce(or_, [key.isNotNull() for key in keys])), keys, *row)
    return by_amount.unionByName(by_table)


def _nearest(asked: DataFrame, points: DataFrame) -> DataFrame:
    """asked with `p` (t, order_no) of the last point before and of the first after, up to two rows each.

    Of points of one moment the smallest order number counts. A visit without a time takes the smallest of its key;
    t is null there.
    """
    both = asked.withColumn("order_no", F.lit(None).cast("string")).unionByName(points.withColumn("visit_id", F.lit(None).cast("bigint")))
    # One number first: rows of different keys are told apart by it alone.
    key = W.partitionBy("h", *KEY)

    def point(t: str, order_no: str) -> Column:
        return F.when(F.col(order_no).isNotNull(), F.struct(F.col(t).alias("t"), F.col(order_no).alias("order_no")))

    # A visit comes after the orders of its moment, and one without a time after all.
    up = key.orderBy(F.asc_nulls_last("t"), F.asc_nulls_last("order_no"), "visit_id")
    here = both.withColumn("h", F.xxhash64(*KEY)).select(
        "*", F.lag("t").over(up).alias("t_above"), F.lag("visit_id").over(up).alias("visit_above"),
        *[F.lead(c).over(up).alias(f"{c}_below") for c in ("visit_id", "t", "order_no")],
    )
    first = F.when(~F.col("t").eqNullSafe(F.col("t_above")), point("t", "order_no"))
    so_far = up.rowsBetween(W.unboundedPreceding, W.currentRow)
    found = here.select("*", F.last(first, ignorenulls=True).over(so_far).alias("before"), F.min("order_no").over(so_far).alias("least"))
    # What follows is known where no visit does; visits above take it over, so orders need not be sorted again,
    # nor do visits alone among themselves that have no order on either side.
    known, below = F.col("visit_id_below").isNull(), point("t_below", "order_no_below").alias("p")
    alone = known & F.col("visit_above").isNull() & F.col("before").isNull() & F.col("order_no_below").isNull()
    found = found.filter(F.col("visit_id").isNotNull() & ~alone).select(
        "h", *KEY, "visit_id", "t", "before", "least", F.when(known, F.struct(below)).alias("next")
    )
    down = key.orderBy(F.desc_nulls_first("t"), F.desc("visit_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumn("after", F.last("next", ignorenulls=True).over(down)["p"])
    least = F.when(F.col("least").isNotNull(), F.struct(F.lit(None).cast("bigint").alias("t"), F.col("least").alias("order_no")))
    near = F.when(F.col("t").isNull(), F.array(least)).otherwise(F.array("before", "after"))
    return found.select(*KEY, "visit_id", F.col("t").alias("v_us"), F.explode(near).alias("p")).filter("p is not null")


def visit_two_of_three(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Best order per visit that has no exact match: most conditions, least time difference, order number."""
    # A visit without an id can't be named in the result.
    v = _left_over(visits, orders).filter("visit_id is not null").select(
        "visit_id",
        "store",
        F.nullif(F.trim("table_name"), F.lit("")).alias("visit_table"),
        B.whole_yuan(F.col("paid")).cast("bigint").alias("yuan"),
        B.micros(F.col("order_time")).alias("v_us"),
        _stretch(B.micros(F.coalesce(F.col("order_time"), F.col("created_at"))), DAY_US).alias("day"),
    )
    # Read by amount, by table and for its tables, and found by a join with all orders.
    v = stored(v, "left-over")
    o = orders.select(
        "order_no",
        "store",
        F.col("table_name").alias("order_table"),
        B.micros(F.col("order_time")).alias("o_us"),
        B.whole_yuan(F.col("amount")).alias("yuan"),
        B.whole_yuan(F.col("revenue")).alias("other_yuan"),
    )
    o = o.filter("o_us is not null and store is not null")
    near = _nearest(_asked(v, _with_tables(v, o)), _order_points(o))

    diff = F.abs(F.col("v_us") - F.col("p.t"))
    close = F.coalesce(diff <= NEAR_US, F.lit(False))
    same_day = F.col("v_us").isNull() | (_stretch(F.col("p.t"), DAY_US) == _stretch(F.col("v_us"), DAY_US))
    both = F.col("yuan").isNotNull() & F.col("order_table").isNotNull()
    near = near.filter(close | (both & same_day))
    n = F.when(close & both, 3).otherwise(2)
    rank = F.struct((-n).alias("n"), F.coalesce(diff, F.lit(2**62)).alias("d"), F.col("p.order_no").alias("o"))
    best = near.groupBy("visit_id").agg(F.min(rank).alias("r"))
    return best.select(
        "visit_id",
        F.col("r.o").alias("order_no"),
        (-F.col("r.n")).alias("n_conditions"),
        F.when(F.col("r.d") < 2**62, F.col("r.d")).alias("diff_us"),
    )


def match_visits(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Visit to order: exact matches and two-of-three matches, the latter flagged."""
    exact = visit_exact_match(visits, orders).withColumn("amount_matched", F.lit(False))
    fuzzy = visit_two_of_three(visits, orders).select("visit_id", "order_no").withColumn("amount_matched", F.lit(True))
    return exact.unionByName(fuzzy)


def visit_unmatched(visits: DataFrame, matches: DataFrame) -> DataFrame:
    return visits.join(matches.select("visit_id"), "visit_id", "left_anti").select(
        "visit_id", "waiter", "created_at", "table_name", "guests", "paid", "order_time", "member_status", "transcript"
    )


def visit_associate(visits: DataFrame, matches: DataFrame, order_groups: DataFrame) -> DataFrame:
    """One row per visit with the group it belongs to; matches into no group are left out."""
    details = visits.select("visit_id", "waiter", F.col("guests").alias("visit_guests"), "satisfaction", "transcript", "created_at")
    return (
        matches.join(order_groups.select("order_no", "group_id"), "order_no").join(details, "visit_id")
    )


def guest_correction(groups: DataFrame, linked: DataFrame) -> DataFrame:
    """Groups with the guests a visit counted; the latest visit with a number above zero counts.

    Visits are reduced to one per group before the join, whatever their number.
    """
    latest = (
        linked.filter(F.col("visit_guests") > 0)
        .groupBy("group_id")
        .agg(F.max(F.struct("created_at", "visit_id", "visit_guests")).alias("v"))
        .select("group_id", F.col("v.visit_guests").alias("visit_guests"))
    )
    out = groups.join(latest, "group_id", "left").withColumn("pos_guests", F.col("guests"))
    changed = F.coalesce(F.col("visit_guests") != F.col("pos_guests"), F.lit(False))
    out = out.withColumn("guests", F.coalesce("visit_guests", "pos_guests")).withColumn("guests_corrected", changed)
    return out.withColumn("per_capita", B.per_capita(F.col("revenue"), F.col("guests"))).drop("visit_guests")


def visit_coverage(groups: DataFrame, linked: DataFrame, by: list[str]) -> DataFrame:
    """Groups, groups with a visit, and their share."""
    seen = linked.select("group_id").distinct().withColumn("visited", F.lit(1))
    return (
        groups.join(seen, "group_id", "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_groups"), F.count("visited").alias("n_visited"))
        .withColumn("coverage", B.ratio(F.col("n_visited"), F.col("n_groups")))
    )
