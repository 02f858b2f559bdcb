"""Expressions over raw spreadsheet cells."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
EMPTY_WORDS = ("", "nan", "none", "nat")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


#: Stretches of code points that hold neither white space nor the first letter of an empty word, in any case.
FULL_STARTS = (("!", "N"), ("O", "n"), ("o", "\x7f"), ("\u3001", None))


def _starts_full(c: Column) -> Column:
    """Texts whose first character alone says that they are no empty cell; nearly all are. Bytes of UTF-8 sort like code points."""
    inside = [(c >= a) & (c < b) if b else c >= a for a, b in FULL_STARTS]
    return reduce(or_, inside)


def is_empty_cell(c: Column) -> Column:
    """Null, blank or a textual null. A dash is a value."""
    return c.isNull() | (~_starts_full(c) & F.lower(strip(c)).isin(*EMPTY_WORDS))


def is_digit_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)^\d+\z"), F.lit(False))


def real_text(c: Column) -> Column:
    """Stripped text, null where blank or a dash."""
    s = strip(c)
    return F.when(~s.isin("", "-"), s)


def parse_time(c: Column) -> Column:
    """Zone-free time of a date or date-time text, null for anything else."""
    t = strip(c)
    t = F.when(F.contains(t, F.lit("/")), F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")).otherwise(t)
    # A date with hours and minutes has 16 characters at most.
    t = F.when(F.length(t) <= 16, F.regexp_replace(t, r"^(\S+[ T]\d{1,2}:\d{2})$", "$1:00")).otherwise(t)
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:$|[ T])"), t.try_cast("timestamp_ntz"))


def cell_at(cells: Column, header: Column, name: str) -> Column:
    """Cell below the first header cell equal to name, null when there is none."""
    pos = F.array_position(header, name)
    return F.when(pos > 0, F.get(cells, (pos - 1).cast("int")))
