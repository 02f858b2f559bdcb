"""Consumption-group merge: fold the tickets of one table into sessions.

Orders less than `concurrent_minutes` after their predecessor always join it. Cutting a
day into slots of that width therefore leaves at most one order per slot, its first, that
can open a session. Slots are built by a plain aggregate (combined on the map side, so a
hot table-day is reduced before the shuffle), and the sequential fold runs over at most
24 h / 5 min = 288 slots of a table-day, whatever the number of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dinefold.functions import business as B
from dinefold.functions.cells import real_text
from dinefold.params import MergeParams
from dinefold.session import stored

DAY = ["store", "table_name", "biz_date"]
HOUR_US = 60 * B.MINUTE_US


def order_features(items: DataFrame) -> DataFrame:
    """Per order what the merge needs to know of its item lines."""
    return items.groupBy("order_no").agg(
        F.count(F.lit(1)).alias("line_cnt"),
        F.every(B.is_drink(F.col("category"))).alias("all_drinks"),
        F.count_if(B.is_snack(F.col("category"))).alias("snack_lines"),
        F.count_if(B.is_packing(F.col("name"), F.col("category"))).alias("packing_lines"),
        # Distinct dish names: bounded by the menu.
        F.collect_set("name").alias("names"),
    )


def with_slots(orders: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Orders with business day and slot.

    Orders without a time have no day and are left out. A missing table or store counts as one
    of its own, blank, so that joins on these keys lose nothing.
    """
    shifted = F.col("order_time") - F.expr(f"INTERVAL '{p.cutover_hour}' HOUR")
    in_day = B.micros(shifted) % F.lit(24 * HOUR_US)
    blank = F.lit("")
    known = orders.filter("order_time is not null").withColumns(
        {"store": F.coalesce("store", blank), "table_name": F.coalesce("table_name", blank)}
    )
    return known.withColumn("biz_date", shifted.cast("date")).withColumn(
        "slot", F.floor(in_day / F.lit(p.concurrent_minutes * B.MINUTE_US)).cast("int")
    )


def prepare_orders(orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Orders with slot, times in microseconds and item features."""
    return attach_features(orders, order_features(items), p)


def attach_features(orders: DataFrame, features: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    none = F.lit(0).cast("bigint")
    return (
        with_slots(orders, p)
        .join(features, "order_no", "left")
        .withColumns(
            {
                "t_us": B.micros(F.col("order_time")),
                "checkout_us": B.micros(F.col("checkout_time")),
                "line_cnt": F.coalesce("line_cnt", none),
                "all_drinks": F.coalesce("all_drinks", F.lit(False)),
                "snack_lines": F.coalesce("snack_lines", none),
                "packing_lines": F.coalesce("packing_lines", none),
                "names": F.coalesce("names", F.array().cast("array<string>")),
            }
        )
    )


def _pay_set(c: Column) -> Column:
    # Fixed value: separators between several ways to pay.
    parts = F.split(c, r"[,，、+/;；\s]+")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: ~x.isin("", "-"))


def _head() -> Column:
    """What the fold reads of an order; the first two fields decide the minimum."""
    return F.struct(
        "t_us",
        "order_no",
        "revenue",
        "guests",
        F.hour("order_time").alias("hour"),
        "line_cnt",
        "all_drinks",
        real_text(F.col("member_phone")).alias("phone"),
        _pay_set(F.col("pay_method")).alias("pays"),
        real_text(F.col("remark")).alias("remark"),
        "names",
    )


def group_partials() -> list[Column]:
    """Group statistics of a slot; free orders count for the merge but not here."""
    paid = F.col("revenue") > 0

    def of(c):
        return F.when(paid, c)

    return [
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(paid).alias("n_orders"),
        F.sum(of(F.col("revenue"))).alias("revenue"),
        F.sum(of(F.col("amount"))).alias("amount"),
        F.min(of(F.col("order_time"))).alias("first_time"),
        F.max(of(F.col("order_time"))).alias("last_time"),
        F.max(of(F.col("checkout_time"))).alias("last_checkout"),
        F.max(of(F.struct("revenue", (-F.col("t_us")).alias("neg_t"), "guests"))).alias("top_order"),
        F.min(of(F.struct("t_us", "order_no", "opener"))).alias("first_opener"),
        F.sum(of(F.col("line_cnt"))).alias("item_count"),
        F.sum(of(F.col("snack_lines"))).alias("snack_lines"),
        F.sum(of(F.col("packing_lines"))).alias("packing_lines"),
        F.bool_or(of(B.is_member(F.col("member_name")))).alias("member"),
    ]


def build_slots(prepared: DataFrame, statistics: bool | list[Column] = True) -> DataFrame:
    """One row per non-empty slot of a table-day: first order, last order and, if wanted, statistics, all or those given."""
    part = group_partials() if statistics is True else statistics or []
    return prepared.groupBy(*DAY, "slot").agg(
        F.min(_head()).alias("head"),
        F.max(F.struct("t_us", "order_no", "checkout_us")).alias("tail"),
        *([F.struct(*part).alias("part")] if part else []),
    )


def is_small(head: Column, anchor: Column, p: MergeParams) -> Column:
    return (head["revenue"] <= anchor["revenue"] * F.lit(p.small_ratio)) | (head["line_cnt"] <= p.small_line_cnt)


def item_jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(
        B.ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))),
        F.lit(0.0),
    )


def weak_score(head: Column, anchor: Column, gap_us: Column, small: Column, jaccard: Column, p: MergeParams) -> Column:
    def pts(cond, n):
        return F.when(cond, F.lit(n)).otherwise(F.lit(0))

    near = F.when(gap_us <= 30 * B.MINUTE_US, 25).when(gap_us <= 60 * B.MINUTE_US, 10).otherwise(0)
    bonus = (
        F.when(~small, 0)
        .when(head["revenue"] < 40, p.small_bonus_low)
        .when(head["revenue"] < 60, p.small_bonus_mid)
        .otherwise(p.small_bonus_high)
    )
    phone = F.coalesce(F.when(head["phone"] == anchor["phone"], 25).when(head["phone"] != anchor["phone"], -10), F.lit(0))
    return (
        F.lit(20)
        + near
        + phone
        + pts(head["guests"] == anchor["guests"], 15)
        + pts(F.arrays_overlap(head["pays"], anchor["pays"]), 5)
        + pts(jaccard >= 0.1, 10)
        + bonus
        + pts(head["remark"] == anchor["remark"], 5)
    )


_STEP = (
    "struct<order_no:string,anchor_no:string,gap_us:bigint,since_first_us:bigint,small:boolean,"
    "r0:boolean,r1:boolean,r2:boolean,r3:boolean,r35:boolean,jaccard:double,score:int,decision:string>"
)


def _step(acc: Column, slot: Column, private: Column, p: MergeParams) -> Column:
    """Rules for the first order of a slot against the open session, first hit decides."""
    head, anchor, prev = slot["head"], acc["anchor"], acc["tail"]
    gap = head["t_us"] - prev["t_us"]
    since = head["t_us"] - anchor["t_us"]
    small = is_small(head, anchor, p)
    window = F.when(private, p.window_hours_private * HOUR_US).otherwise(p.window_hours_regular * HOUR_US)
    reopen = F.when(private, p.reopen_min_private * B.MINUTE_US).otherwise(p.reopen_min_regular * B.MINUTE_US)
    jaccard = item_jaccard(head["names"], anchor["names"])

    def flag(c):
        return F.coalesce(c, F.lit(False))

    r0 = flag(gap < p.concurrent_minutes * B.MINUTE_US)
    r1 = flag((since > window) & ~small)
    r2 = flag(
        (head["revenue"] > anchor["revenue"] * F.lit(p.add_on_max_ratio)) & (anchor["revenue"] > F.lit(p.anchor_min_amount))
    )
    r3 = flag((head["t_us"] - prev["checkout_us"] > reopen) & ~small)
    r35 = flag(
        private & (head["hour"] >= p.dinner_start_hour) & (head["hour"] < p.dinner_end_hour) & head["all_drinks"]
    )
    score = weak_score(head, anchor, gap, flag(small), jaccard, p)
    decision = (
        F.when(prev.isNull(), "first")
        .when(r0, "R0")
        .when(r1, "R1")
        .when(r2, "R2")
        .when(r3, "R3")
        .when(r35, "R3.5")
        .when(score >= p.score_threshold, "score_merge")
        .otherwise("score_split")
    )
    opens = decision.isin("first", "R1", "R2", "R3", "score_split")
    return F.struct(
        head["order_no"].alias("order_no"),
        F.when(opens, head["order_no"]).otherwise(acc["group_no"]).alias("group_no"),
        F.struct(
            head["order_no"].alias("order_no"),
            anchor["order_no"].alias("anchor_no"),
            gap.alias("gap_us"),
            since.alias("since_first_us"),
            flag(small).alias("small"),
            r0.alias("r0"),
            r1.alias("r1"),
            r2.alias("r2"),
            r3.alias("r3"),
            r35.alias("r35"),
            jaccard.alias("jaccard"),
            score.alias("score"),
            decision.alias("decision"),
        ).cast(_STEP).alias("step"),
        opens.alias("opens"),
    )


def fold_slots(slots: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Slots with the group they belong to and the decision on their first order; their statistics, if they have them, are kept."""
    part = [c for c in ("part",) if c in slots.columns]
    head_t = slots.schema["head"].dataType.simpleString()
    tail_t = slots.schema["tail"].dataType.simpleString()
    out_t = f"array<struct<group_no:string,step:{_STEP}>>"
    acc_t = f"struct<anchor:{head_t},tail:{tail_t},group_no:string,out:{out_t}>"
    private = B.is_private(F.col("table_name"))

    def merge(acc, slot):
        s = F.transform(F.array(slot), lambda x: _step(acc, x, private, p))[0]
        return F.transform(
            F.array(s),
            lambda d: F.struct(
                F.when(d["opens"], slot["head"]).otherwise(acc["anchor"]).alias("anchor"),
                slot["tail"].alias("tail"),
                d["group_no"].alias("group_no"),
                F.concat(
                    acc["out"], F.array(F.struct(d["group_no"].alias("group_no"), d["step"].alias("step")))
                ).cast(out_t).alias("out"),
            ).cast(acc_t),
        )[0]

    start = F.struct(
        F.lit(None).cast(head_t).alias("anchor"),
        F.lit(None).cast(tail_t).alias("tail"),
        F.lit(None).cast("string").alias("group_no"),
        F.array().cast(out_t).alias("out"),
    ).cast(acc_t)
    days = slots.groupBy(*DAY).agg(
        # At most 288 entries: see the module text.
        F.array_sort(F.collect_list(F.struct("slot", "head", "tail", *part))).alias("slots")
    )
    folded = days.withColumn("out", F.aggregate("slots", start, merge, lambda acc: acc["out"]))
    return folded.select(*DAY, F.explode(F.arrays_zip("slots", "out")).alias("z")).select(
        *DAY,
        F.col("z.slots.slot").alias("slot"),
        F.col("z.slots.head").alias("head"),
        *[F.col(f"z.slots.{c}").alias(c) for c in part],
        F.col("z.out.group_no").alias("group_id"),
        F.col("z.out.step").alias("step"),
    )


def explain_slots(orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Rule values and decision for the first order of every slot."""
    folded = fold_slots(build_slots(prepare_orders(orders, items, p), statistics=False), p)
    return folded.select(*DAY, "slot", "group_id", "step.*")


def merge_explain(orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Group, anchor, decision and rule values of every order.

    The first order of a table-day and concurrent orders (R0) are decided before any other rule, so they
    have no rule values; their anchor is the order that opened the group.
    """
    values = ["gap_us", "since_first_us", "small", "r1", "r2", "r3", "r35", "jaccard", "score"]
    steps = explain_slots(orders, items, p).withColumnsRenamed({"order_no": "head_no", "decision": "head_decision"})
    rows = with_slots(orders, p).select(*DAY, "slot", "order_no").join(steps, [*DAY, "slot"])
    decision = F.when(F.col("order_no") == F.col("head_no"), F.col("head_decision")).otherwise("R0")
    judged = ~F.col("decision").isin("first", "R0")
    return rows.withColumn("decision", decision).select(
        "order_no", *DAY, "group_id", F.when(judged, F.col("anchor_no")).otherwise(F.col("group_id")).alias("anchor_no"),
        *[F.when(judged, F.col(c)).alias(c) for c in values], "decision",
    )


def session_merge(
    orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams(), features: bool = False
) -> DataFrame:
    """Every order with its group and the decision that put it there.

    With features the rows also carry what `groups.groups_from_merged` reads of the item lines; orders with their
    features are then written once, for the fold and for the rows, so that all lines are read and grouped once.
    """
    key = [*DAY, "slot"]
    prepared = prepare_orders(orders, items, p)
    if features:
        prepared = stored(prepared, "prepared")
    rows = prepared.drop("all_drinks", "names") if features else with_slots(orders, p)
    # Statistics of groups are read off the rows, not off the slots.
    groups = fold_slots(build_slots(prepared, statistics=False), p).select(
        *key, "group_id", F.col("step.decision").alias("head_decision"), F.col("head.order_no").alias("head_no")
    )
    # One row per slot on the right; the adaptive split of skewed joins spreads the orders of a hot slot.
    return (
        rows.join(groups, key)
        .withColumn("decision", F.when(F.col("order_no") == F.col("head_no"), F.col("head_decision")).otherwise("R0"))
        .drop("head_no", "head_decision")
    )


def concurrent_blocks(orders: DataFrame, items: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """The concurrency rule alone: orders and blocks per table-day."""
    slots = build_slots(prepare_orders(orders, items, p))
    day = W.partitionBy(*DAY).orderBy("slot")
    gap = F.col("head.t_us") - F.lag("tail.t_us").over(day)
    marked = slots.withColumn("new_block", (gap.isNull() | (gap >= p.concurrent_minutes * B.MINUTE_US)).cast("int"))
    return marked.groupBy(*DAY).agg(
        F.sum("part.n_all").alias("n_orders"), F.sum("new_block").cast("bigint").alias("n_blocks")
    )
