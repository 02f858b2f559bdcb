"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces of that length and a rest, so
nothing is dropped. Pieces are dealt to packing groups of bounded size by a hash; a group is packed on
its own, longest pieces first:

1. a piece goes into the open bin that it fills best;
2. if none has room, a bin is opened, of the length that the group's plan names for the piece's length class;
3. at the end, each bin shrinks to the smallest permitted length that holds its contents.

The plan is chosen for all permitted lengths of a group jointly. It starts with the smallest length that holds the piece.
Then one class after the other tries every longer length, the whole group is packed and shrunk, and the plan of
least total cost is kept, until a round over all classes changes nothing or `ROUNDS` are done. So the
layout never costs more than that of the smallest fit.

The cost of a bin of length c is c * (1 + ATTENTION * c): a part in proportion to its tokens and a part
that grows with the square of its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import small_batches

SIZES = (2048, 4096, 8192, 16384)
ATTENTION = 1 / 65536
#: Pieces of one packing group, on average.
GROUP_PIECES = 20000
#: Length classes of a plan, by equal shares of the pieces; rounds in search of the plan.
CLASSES = 12
ROUNDS = 2


def cost(size: int) -> float:
    return size * (1 + ATTENTION * size)


def fill(lengths: list[int], opened: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each length and the tokens of each bin; piece i opens a bin of opened[i] if none has room."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin with room r is open
    for i, length in enumerate(lengths):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(used), opened[i]
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        left = room - length
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins, offsets, used


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, bin size) of each length; lengths are in descending order and within the largest size."""
    if not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    permitted = np.array(sorted(sizes))
    costs = np.array([cost(int(c)) for c in permitted])
    smallest = np.searchsorted(permitted, lengths)
    ends = np.quantile(lengths, np.arange(1, classes) / classes, method="lower")
    kind = np.searchsorted(np.unique(ends), lengths)
    plain = lengths.tolist()

    def layout(plan: np.ndarray):
        out = fill(plain, permitted[np.maximum(smallest, plan[kind])].tolist())
        final = np.searchsorted(permitted, out[2])
        return float(costs[final].sum()), out, permitted[final]

    plan = np.zeros(int(kind.max()) + 1, np.int64)
    best = layout(plan)
    for _ in range(rounds):
        before = best[0]
        for k in range(len(plan)):
            # Plans below the smallest fit of the class are all the same plan.
            least = int(smallest[kind == k].min(initial=len(permitted)))
            for size in (s for s in range(least, len(permitted)) if s != max(least, plan[k])):
                tried = plan.copy()
                tried[k] = size
                found = layout(tried)
                if found[0] < best[0]:
                    plan, best = tried, found
        if best[0] == before:
            break
    bins, offsets = (np.array(x, np.int64) for x in best[1][:2])
    return bins, offsets, best[2][bins]


def pieces_of(df: DataFrame, id_col: str, length, largest: int) -> DataFrame:
    """(doc_id, piece, piece_start, length): whole documents, or pieces of the largest permitted length."""
    n = F.col("_n")
    parts = df.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("_n")).where("_n > 0")
    parts = parts.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / largest).cast("long"))).alias("piece"))
    start = F.col("piece") * largest
    return parts.select("doc_id", "piece", start.alias("piece_start"), F.least(F.lit(largest), n - start).cast("int").alias("length"))


def best_fit(df: DataFrame, length, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, group_pieces: int = GROUP_PIECES, seed: int = 11) -> DataFrame:
    """(doc_id, piece, piece_start, length, bin_id, bin_offset, bin_size), one row per piece.

    length: a column with the tokens of a document; rows with none, or a null, take no place and have no
    row. Rows without an id are packed like others; rows that repeat an id are packed separately. Equal
    lengths are taken in the order of their ids. An empty table gives no rows.
    """
    spark = small_batches(df.sparkSession)
    pieces = pieces_of(df, id_col, length, max(sizes))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "length"), F.lit(groups)))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, size = pack(group["length"].to_numpy(), sizes)
        # The group in the upper bits keeps bin numbers of different groups apart.
        number = (group["_group"].to_numpy() << 32) + bins
        out = group.select(["doc_id", "piece", "piece_start", "length"])
        for name, values in (("bin_id", pa.array(number)), ("bin_offset", pa.array(offsets)), ("bin_size", pa.array(size, pa.int32()))):
            out = out.append_column(name, values)
        return out

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    # Groups are small tables but long work: a number of partitions that is named is not lowered at run time.
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 16))
    return dealt.repartition(tasks, "_group").groupBy("_group").applyInArrow(one, "doc_id long, piece long, piece_start long, length int, bin_id long, bin_offset long, bin_size int")


def byte_tokens(text_col: str = "text"):
    """Length under a byte-level vocabulary with an end token: UTF-8 bytes plus one. Null counts as empty."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
