"""Expressions of the order domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dinefold import params as P
from dinefold.functions.cells import real_text

MINUTE_US = 60_000_000


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the zone of the session."""
    seconds = F.date_part(F.lit("SECOND"), c)
    whole = F.unix_date(c.cast("date")).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
    return whole * MINUTE_US + (seconds * 1_000_000).cast("bigint")


def contains_any(c: Column, words) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), F.lit(False))


def by_store(store: Column, pick) -> Column:
    """A per-store literal: stores without an entry take the default."""
    out = F.lit(pick(P.STORE_DEFAULT))
    for name, p in P.STORE_PARAMS.items():
        out = F.when(store == name, F.lit(pick(p))).otherwise(out)
    return out


def normalize_store(raw: Column) -> Column:
    return (
        F.when(raw.contains("万荷"), F.lit(P.STORE_A))
        .when(raw.contains("保利"), F.lit(P.STORE_B))
        .when(raw.isNull() | (raw == ""), F.lit(P.STORE_UNKNOWN))
        .otherwise(raw)
    )


# Fixed value: two ISO dates in one line of text.
DATE_RANGE = r"(?dU)(\d{4}-\d{2}-\d{2}).*?(\d{4}-\d{2}-\d{2})"


def range_start(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DATE_RANGE, 1), F.lit(""))


def range_end(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, DATE_RANGE, 2), F.lit(""))


def is_private(table: Column) -> Column:
    return contains_any(table, P.PRIVATE_WORDS)


def area_class(store: Column, table: Column) -> Column:
    def words(ws):
        out = F.lit(P.AREA_OTHER)
        for w in reversed(ws):
            out = F.when(table.contains(w), F.lit(w)).otherwise(out)
        return out

    out = words(P.STORE_DEFAULT.area_words)
    for name, p in P.STORE_PARAMS.items():
        out = F.when(store == name, words(p.area_words)).otherwise(out)
    return out


def daypart(t: Column) -> Column:
    return F.when(F.hour(t) < 16, F.lit(P.LUNCH)).otherwise(F.lit(P.DINNER))


def is_member(name: Column) -> Column:
    return real_text(name).isNotNull()


def is_drink(category: Column) -> Column:
    return F.coalesce(category.isin(*P.DRINK_CATEGORIES), F.lit(False))


def is_snack(category: Column) -> Column:
    return F.coalesce(category == P.SNACK_CATEGORY, F.lit(False))


def is_packing(name: Column, category: Column) -> Column:
    return F.coalesce(name.contains(P.PACKING_WORD), F.lit(False)) | F.coalesce(
        category.contains(P.PACKING_WORD), F.lit(False)
    )


def per_capita(revenue: Column, guests: Column) -> Column:
    return F.try_divide(revenue, F.nullif(guests, F.lit(0)).cast("decimal(10,0)")).cast("decimal(18,2)")


def price_band(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, low in reversed(P.PRICE_BANDS):
        out = F.lit(label) if low is None else F.when(value >= low, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def opener_label(opener: Column) -> Column:
    return F.when(opener == P.SYSTEM_OPENER, F.lit(P.SCAN_OPENER)).otherwise(opener)


def core_name(name: Column) -> Column:
    """Name without a trailing size, bare or in brackets."""
    sizes = "|".join(P.SIZE_SUFFIXES)
    core = F.regexp_replace(name, rf"\s*(?:（(?:{sizes})）|\((?:{sizes})\)|(?:{sizes}))\s*$", "")
    return F.coalesce(F.nullif(F.trim(core), F.lit("")), name)


def whole_yuan(amount: Column) -> Column:
    return F.floor(amount + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is zero."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
