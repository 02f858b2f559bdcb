"""How the filters of a cleaning chain interact, for every order in which they can be applied.

Every document fails a set of filters, a bit mask. The states of a chain are the subsets of filters
applied so far, a lattice; applying filter f in state S is the edge from S to S + f, and it removes the
documents that fail f and nothing in S. All orders are paths from the empty to the full set, so the
removals of the 2^(k-1) * k edges tell everything about the k! orders. Paths are counted forward (orders
that reach a state) and backward (orders that lead on from it); their product is the number of orders that
use an edge, its weight in the Shapley values. Single orders are read off the same edges.

The texts are read once and become one mask per document; only counts per part and mask go further.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow
from dinefold.session import stored

UPPER = bytes(range(0x41, 0x5B))
JUNK = b"#$%&*|"

MEASURES = ("n", "good", "toxic")


def text_mask(text: str, raw: bytes) -> int:
    """Bits 0 to 3: fewer than 200 words; under half of the words distinct; over 3 % capitals; a symbol of junk."""
    words = raw.split()  # at ASCII white space, as bytes do
    capitals = len(raw) - len(raw.translate(None, UPPER))
    failures = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * capitals > 3 * len(text),
        len(raw.translate(None, JUNK)) < len(raw),
    )
    return sum(f << i for i, f in enumerate(failures))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per id: 1 where any label of the id says so."""
    rows = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    flag = {"good": F.max((F.col("quality") == 1).cast("int")), "toxic": F.max((F.col("toxic") == 1).cast("int"))}
    return rows.groupBy("doc_id").agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in flag.items()))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and by what they fail, filter E (copies) as bit 4.

    A row fails E if a smaller doc_id has the same text. Rows of the smallest id of a text pass, found by
    text and id together, so that a text which a third of all rows share is never joined by its digest alone.
    A row without an id is no copy of another and none of it. Null texts count as empty, a null lang as part
    ''. An empty table gives no rows; rows that repeat an id and its text all count.
    """

    def read(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch["text"].to_pylist()]
        raw = [t.encode() for t in texts]
        return {
            "doc_id": batch["doc_id"],
            "part": batch["part"],
            "mask": [text_mask(t, r) for t, r in zip(texts, raw)],
            "digest": [hashlib.sha256(r).digest() for r in raw],
        }

    part = F.coalesce("lang", F.lit("")).alias("part")
    rows = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, "text"), read, "doc_id long, part string, mask int, digest binary")
    rows = stored(rows.join(label_flags(labels), "doc_id", "left"), "filter-masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    # Ids are all but unique, so this key has no hot value; rows without an id never match and pass E.
    marked = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    ones = {"n": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
    counts = marked.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    return counts.agg(*(F.sum(v).cast("long").alias(k) for k, v in ones.items()))


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For every state, the orders of its filters that reach it and those of the others that leave it."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s in range(full + 1):
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in range(full, -1, -1):
        backward[s] = backward[s] or sum(backward[s | 1 << f] for f in range(k) if not s >> f & 1)
    return forward, backward


def edge_table(masks: DataFrame, k: int) -> DataFrame:
    """(part, state, f, weight, removed, good_lost, toxic_lost, kept, fails, unique_fails) of every edge, zeros included.

    masks: (part, mask, n, good, toxic). Each of its rows, at most 2^k a part, meets the k * 2^(k-1) edges.
    """
    forward, backward = path_counts(k)
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    literal = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("weight")) for s, f, w in edges))
    met = masks.select("part", "mask", *MEASURES, F.inline(literal))
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = {
        "removed": (passed & fails, "n"),
        "good_lost": (passed & fails, "good"),
        "toxic_lost": (passed & fails, "toxic"),
        "kept": (passed & ~fails, "n"),
        "fails": (fails, "n"),
        "unique_fails": (F.col("mask") == F.col("bit"), "n"),
    }
    return met.groupBy("part", "state", "f", "weight").agg(*(F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name) for name, (c, v) in total.items()))


def shapley(edges: DataFrame) -> DataFrame:
    """(part, f, shapley): what a filter removes, summed over all orders; divided by k!, its Shapley value."""
    return edges.groupBy("part", "f").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))


def order_steps(spark, names: str) -> DataFrame:
    """(filter_order, step, state, f): the edges of every order, k * k! rows."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, f int")


def audit(masks: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step; a filter's name is one letter of `names`, bit i its i-th.

    The constant tables of edges and steps have k * 2^(k-1) and k * k! rows; k is at most 7.
    """
    if not 0 < len(names) <= 7 or len(set(names)) < len(names):
        raise ValueError("one to seven filters, each with a letter of its own")
    edges = stored(edge_table(masks, len(names)), "filter-edges")
    # The steps are a constant of the code: 600 rows for five filters.
    steps = F.broadcast(order_steps(masks.sparkSession, names))
    letter = F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1)
    return (
        edges.join(shapley(edges), ["part", "f"])
        .join(steps, ["state", "f"])
        .select(
            "part", "filter_order", "step", letter.alias("filter"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
            "unique_fails", "good_lost", "toxic_lost", "shapley", (F.col("shapley") / math.factorial(len(names))).alias("shapley_mean"),
        )
    )


ORACLE = r"""
with recursive flags as (
  select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic
  from labels where doc_id is not null group by doc_id),
texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents),
failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (len(words) < 200) as a, (100 * len(list_distinct(words)) < 50 * len(words)) as b,
         (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)) as c,
         regexp_matches(text, '[#$%&*|]') as d, coalesce(t.doc_id > first_id, false) as e
  from texts t left join flags using (doc_id)),
counted as (
  select part, a, b, c, d, e, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all),
orders as (
  select '' as o, 0 as k union all
  select o || f, k + 1 from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where k < 5 and not contains(o, f)),
steps as (
  select o as filter_order, step::int as step, substr(o, step, 1) as f, substr(o, 1, step - 1) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step) where k = 5),
each as (
  select part, filter_order, step, f, n, good, toxic,
         (contains(before, 'A') and a) or (contains(before, 'B') and b) or (contains(before, 'C') and c)
           or (contains(before, 'D') and d) or (contains(before, 'E') and e) as gone,
         case f when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails,
         a::int + b::int + c::int + d::int + e::int as failures
  from counted, steps),
summed as (
  select part, filter_order, step, f as "filter",
         sum(case when not gone and not fails then n else 0 end)::bigint as kept,
         sum(case when not gone and fails then n else 0 end)::bigint as removed,
         sum(case when gone and fails then n else 0 end)::bigint as redundant,
         sum(case when fails and failures = 1 then n else 0 end)::bigint as unique_fails,
         sum(case when not gone and fails then good else 0 end)::bigint as good_lost,
         sum(case when not gone and fails then toxic else 0 end)::bigint as toxic_lost
  from each group by all)
select *, (sum(removed) over (partition by part, "filter"))::bigint as shapley,
       (sum(removed) over (partition by part, "filter"))::double / 120 as shapley_mean
from summed
"""
