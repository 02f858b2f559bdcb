"""Stored history: orders, groups and item lines by business day and store, and the daily marts.

Every table is a folder partitioned by (biz_date, store), so a report of a week reads the files of that week. Item
lines are stored with the group of their order: reports need neither a merge nor a join.

A load takes a batch of orders with all their lines and refolds only what it changes. An order is changed if
its number is new or its digest (its columns and its lines) differs from the stored one. The merge never looks
beyond a table and a day, so the table-days of changed orders, their old ones included, are folded anew;
all other rows of the same partitions are carried over, and only those partitions are replaced. A load without
news writes nothing. Orders are replaced last: a load that broke off finds the same orders changed when it is
run again and replaces the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinefold.operators import cleaning as C
from dinefold.operators import drinks as D
from dinefold.operators import marts as M
from dinefold.operators.groups import groups_from_merged, kept
from dinefold.operators.sessions import DAY, session_merge, with_slots
from dinefold.params import MergeParams
from dinefold.session import stored
from dinefold.sources.store import mart_overwrite

PART = ["biz_date", "store"]
MARTS = {"daily_overview": M.daily_overview, "daily_buckets": M.daily_buckets, "daily_opener_stats": M.daily_opener_stats}
# Marts of the lines of counted groups.
LINE_MARTS = {"daily_drink_sets": D.drink_sets, "daily_drinks": D.drink_sums}


def line_mart(name: str, lines: DataFrame) -> DataFrame:
    return LINE_MARTS[name](C.sold_items(lines.filter("counted")), PART)


def _digest(cols: list[str]):
    """64 bits of a row's values; nulls count, the order of columns does not."""
    return F.xxhash64(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}))


def with_digest(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with a digest of their columns and of their lines in any order."""
    lines = items.groupBy("order_no").agg(F.sum(_digest(items.columns).cast("decimal(38,0)")).alias("_lines"), F.count(F.lit(1)).alias("_n"))
    return orders.join(lines, "order_no", "left").withColumn("digest", _digest([*orders.columns, "_lines", "_n"])).drop("_lines", "_n")


class History:
    """The tables below `path`: orders, items, groups and the daily marts. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, p: MergeParams = MergeParams()):
        self.spark, self.path, self.p = spark, path.rstrip("/"), p

    def _folder(self, name: str):
        """The table's folder as a Hadoop path, and the file system that holds it."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "orders") -> bool:
        folder, fs = self._folder(name)
        return fs.exists(folder)

    def _whole(self, name: str) -> bool:
        """The mart holds all days; set once a load has written it from all lines. Readers skip names with `_`."""
        return self.exists(f"{name}/_whole")

    def _filled(self, name: str) -> bool:
        folder, fs = self._folder(name)
        return bool(len(fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder, "biz_date=*/store=*")) or []))

    def table(self, name: str) -> DataFrame:
        """A stored table. Partition columns keep their types, whatever the values look like; a blank store stays blank.

        A mart of lines that was never written whole, as in a history older than the mart, or that has no row, is
        computed from the stored lines.
        """
        if name in LINE_MARTS and not (self._whole(name) and self._filled(name)):
            return line_mart(name, self.table("items"))
        path = f"{self.path}/{name}"
        found = self.spark.read.parquet(path).schema
        data = [f for f in found.fields if f.name not in PART]
        schema = T.StructType([*data, T.StructField("biz_date", T.DateType()), T.StructField("store", T.StringType())])
        return self.spark.read.schema(schema).parquet(path).withColumn("store", F.coalesce("store", F.lit("")))

    def _replace(self, name: str, rows: DataFrame, parts: DataFrame) -> None:
        """Replace the partitions `parts` of a table by rows; a partition without rows goes."""
        mart_overwrite(rows, f"{self.path}/{name}", PART)
        # Days and stores of one load, not rows.
        gone = parts.join(rows.select(*PART).distinct(), PART, "left_anti").collect()
        folder, fs = self._folder(name)
        jvm = self.spark._jvm
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in gone:
            store = escaped(r["store"]) if r["store"] else "__HIVE_DEFAULT_PARTITION__"
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"biz_date={r['biz_date']}/store={store}"), True)

    def load(self, orders: DataFrame, items: DataFrame) -> DataFrame:
        """Bring a batch of clean orders, one row per order number, with all lines of each, into the history.

        Returns the table-days (store, table_name, biz_date) that were folded. Orders without a time are left out, as
        the merge does. Lines of orders that the batch does not hold are not read.
        """
        raw, lines = orders.columns, items.columns
        incoming = with_slots(with_digest(orders, items), self.p).drop("slot")
        first = not self.exists()
        if first:
            changed = stored(incoming, "history-changed")
            days = changed.select(*DAY).distinct()
        else:
            # Order numbers and digests of all days: a number may come back on another day.
            known = self.table("orders").select("order_no", "digest", *DAY)
            changed = stored(incoming.join(known, ["order_no", "digest"], "left_anti"), "history-changed")
            moved = known.join(changed.select("order_no"), "order_no", "left_semi").select(*DAY)
            days = changed.select(*DAY).unionByName(moved).distinct()
        days = stored(days, "history-days")
        parts = days.select(*PART).distinct()
        # Bounded by the calendar; as literals they select the folders to read.
        dates = [r[0] for r in days.select("biz_date").distinct().collect()]
        if not dates:
            return days

        new_items = items.join(changed.select("order_no"), "order_no", "left_semi")
        fold, fold_items = changed.select(*raw, "digest"), new_items
        rest: dict[str, DataFrame] = {}
        if not first:
            ids = changed.select("order_no")
            near = {n: self.table(n).filter(F.col("biz_date").isin(dates)).join(parts, PART, "left_semi") for n in ("orders", "items", "groups")}
            rest = {n: df.join(days, DAY, "left_anti") for n, df in near.items()}
            inside = near["orders"].join(days, DAY, "left_semi").join(ids, "order_no", "left_anti")
            fold = fold.unionByName(inside.select(*raw, "digest"))
            old = near["items"].join(days, DAY, "left_semi").join(ids, "order_no", "left_anti")
            fold_items = new_items.unionByName(old.select(*lines))

        merged = stored(session_merge(fold, fold_items, self.p, features=True), "history-merged")
        groups = stored(groups_from_merged(merged), "history-groups")
        counted = kept(groups).select("group_id", F.col("daypart").alias("group_daypart"))
        of = merged.select("order_no", *DAY, "group_id", (F.col("revenue") > 0).alias("paid")).join(counted, "group_id", "left")
        of = of.withColumn("counted", F.coalesce("paid", F.lit(False)) & F.col("group_daypart").isNotNull())
        sold = fold_items.select(*lines).join(of, "order_no")

        def whole(name: str, rows: DataFrame) -> DataFrame:
            return stored(rows.unionByName(rest[name]) if rest else rows, f"history-{name}")

        all_groups = whole("groups", groups)
        all_items = whole("items", sold)
        self._replace("items", all_items, parts)
        self._replace("groups", all_groups, parts)
        for name, mart in MARTS.items():
            self._replace(name, stored(mart(kept(all_groups)), f"history-{name}"), parts)
        for name in LINE_MARTS:
            lines = all_items if first or self._whole(name) else self.table("items")
            self._replace(name, stored(line_mart(name, lines), f"history-{name}"), parts)
            folder, fs = self._folder(f"{name}/_whole")
            fs.create(folder, True).close()
        self._replace("orders", whole("orders", merged), parts)
        return days
