"""Stretches of a text that repeat with a period: maximal runs of words.

The suffixes of a text are put in order with the common prefixes (LCP) of neighbours, and classes of
suffixes are united in the order of decreasing LCP, as Kruskal's algorithm does with edges. Each class
keeps its positions in order. If a union at LCP L makes positions a < b neighbours and b - a <= L, the text
from a on has the period b - a for L + b - a words; and every run is found this way, at the union of its
start and the position one period later: no position between the two can share a longer prefix with
the start, or the period would not be the smallest. A seed whose words before a and b agree starts inside
a run that another seed gives, and is left out, so each run is found once.

A run of at least `exponent` periods and `least` words has an LCP of at least min_lcp() words. Suffixes whose
first min_lcp() words stand nowhere else in their text are never united and leave before the sort.
All texts of a batch are sorted together; their words are numbered apart, so that no class spans two texts.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow

#: Shortest run in periods and in words.
EXPONENT, LEAST = 4, 6
#: Bytes of text that are sorted together; a longer text is sorted alone.
SORT_BYTES = 4 << 20


class Run(NamedTuple):
    start: int
    length: int
    period: int


def min_lcp(exponent: int, least: int) -> int:
    """The smallest LCP of a run's start and the position one period later."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def numbered_words(texts: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, numbers of their own around each text, and where texts start."""
    parts, starts, used, at = [np.zeros(1, np.int64)], [], 1, 1
    for words in texts:
        place = dict.fromkeys(words)
        place = dict(zip(place, range(used, used + len(place))))
        used += len(place)
        row = np.empty(len(words) + 1, np.int64)
        row[:-1] = list(map(place.__getitem__, words))
        row[-1] = used
        used += 1
        starts.append(at)
        at += len(row)
        parts.append(row)
    parts.append(np.arange(used, used + 2 * k))
    return np.concatenate(parts), np.array(starts, np.int64)


def repeated_prefixes(x: np.ndarray, k: int) -> np.ndarray:
    """Positions, in order, whose first k numbers stand at another place too, and the k positions after each.

    The latter decide how suffixes that share k numbers go on. A few others may be among them.
    """
    n = len(x) - k + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ x[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    wanted = np.zeros(len(x), bool)
    for i in range(k + 1):
        wanted[i:n] |= twice[: n - i]
    return np.flatnonzero(wanted)


def suffix_order(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions `at` in the order of their suffixes, and names of their prefixes.

    names[i] has a number for each of `at`, equal where the first k << i numbers are and in their order. Names
    double in length until every suffix has its own; a name is the place of the first suffix that has it.
    """
    m = len(at)
    name = np.empty(len(x), np.int64)
    order = at[np.lexsort([x[at + i] for i in range(k - 1, -1, -1)])]
    new = np.ones(m, bool)
    new[1:] = np.any([x[order[1:] + i] != x[order[:-1] + i] for i in range(k)], axis=0)
    name[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    names = [name[at]]
    while True:
        # Places that still share a name with a neighbour.
        open_ = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(open_):
            return order, names
        here = order[open_]
        first, second = name[here], name[here + k]
        sort = np.lexsort((second, first))
        here, first, second = here[sort], first[sort], second[sort]
        order[open_] = here
        split = np.ones(len(here), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[open_] = split
        name[here] = open_[np.maximum.accumulate(np.where(split, np.arange(len(here)), 0))]
        names.append(name[at])
        k *= 2


def common_prefixes(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """suffix_order() and the LCP of each suffix with the one before it, 0 where they share less than k numbers.

    An LCP is the sum of the longest equal prefixes, halved step by step, and fewer than k single numbers.
    """
    order, names = suffix_order(x, at, k)
    place = np.full(len(x), -1, np.int64)
    place[at] = np.arange(len(at))
    i, j = order[1:].copy(), order[:-1].copy()
    for level in range(len(names) - 1, -1, -1):
        a, b = place[i], place[j]
        step = np.where((a >= 0) & (b >= 0) & (names[level][a] == names[level][b]), k << level, 0)
        i += step
        j += step
    same = np.ones(len(i), bool)
    for _ in range(k - 1):
        same &= x[i] == x[j]
        i += same
        j += same
    lcp = np.append(0, i - order[1:])
    return order, np.where(lcp < k, 0, lcp)


def seeds(order: np.ndarray, lcp: np.ndarray, exponent: int):
    """(a, b, L) of positions that a union at LCP L makes neighbours, no further apart than L / (exponent - 1)."""
    edges = np.flatnonzero(lcp)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent = list(range(len(order)))
    members: list = [[p] for p in order.tolist()]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for e, level in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = find(e - 1), find(e)
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        members[b] = None
        span = level // (exponent - 1)
        places = [bisect_left(large, p) for p in small]
        for i, (p, k) in enumerate(zip(small, places)):
            if k and (not i or places[i - 1] != k) and p - large[k - 1] <= span:
                yield large[k - 1], p, level
            if k < len(large) and (i + 1 == len(small) or places[i + 1] != k) and large[k] - p <= span:
                yield p, large[k], level
        if len(small) == 1:
            large.insert(places[0], small[0])
        else:
            # Two ordered stretches: the sort merges them in one pass.
            large += small
            large.sort()


def runs_of(texts: list[list[bytes]], exponent: int = EXPONENT, least: int = LEAST) -> list[list[Run]]:
    """The runs of each list of words, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    k = min_lcp(exponent, least)
    out: list[list[Run]] = [[] for _ in texts]
    x, starts = numbered_words(texts, k)
    at = repeated_prefixes(x, k)
    if not len(at):
        return out
    order, lcp = common_prefixes(x, at, k)
    for a, b, level in seeds(order, lcp, exponent):
        period = b - a
        if x[a - 1] != x[b - 1] and level + period >= max(least, exponent * period):
            doc = int(np.searchsorted(starts, a, "right")) - 1
            out[doc].append(Run(a - int(starts[doc]), level + period, period))
    for own in out:
        own.sort(key=lambda r: (r.start, r.period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    kept, last = [], 0
    for a, b in sorted((r.start + r.period, r.start + r.length) for r in runs):
        kept += words[last : max(a, last)]
        last = max(last, b)
    return b" ".join(kept + words[last:])


def _sorted_together(texts: list[list[bytes]], sizes: list[int], exponent: int, least: int) -> list[list[Run]]:
    out, first, size = [], 0, 0
    for i, s in enumerate(sizes):
        if i > first and size + s > SORT_BYTES:
            out += runs_of(texts[first:i], exponent, least)
            first, size = i, 0
        size += s
    return out + runs_of(texts[first:], exponent, least)


def periodic_runs(df: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of df.

    runs: structs (start, length, period) of all stretches of at least `exponent` periods and `least` words,
    word numbers from 0. collapsed: the text with each run cut to its first period. Null texts count as empty
    and have no words. Rows without an id and repeated rows are read like any other; an empty table gives no
    rows; other columns, whatever their names, are not read. Long texts are read whole: a text of n words takes
    some 200 n bytes in its task.
    """

    def read(batch: pa.RecordBatch) -> dict:
        raw = [(t or "").encode() for t in batch["text"].to_pylist()]
        texts = [r.split() for r in raw]  # at ASCII white space, as bytes do
        found = _sorted_together(texts, list(map(len, raw)), exponent, least)
        return {
            "doc_id": batch["doc_id"],
            "n_words": list(map(len, texts)),
            "runs": [[r._asdict() for r in own] for own in found],
            "collapsed": [collapsed(words, own).decode() for words, own in zip(texts, found)],
        }

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return in_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the hash of its id gets a periodic tail, as the contract of op13 says.

    A document without an id stays as it is.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    # Only the tenth is cut into words.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)"))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(tail).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """What the contract of op13 asks for, from the runs and collapsed texts of periodic_runs()."""

    def sha(c: Column) -> Column:
        return F.sha2(F.encode(c, "UTF-8"), 256)

    # The greatest exponent by exact fractions; runs come by start, then period, so the first of equals stays.
    best = F.expr("""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
        (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
