"""Near-duplicates by SimHash, linked exactly with a vantage-point tree over Hamming distance.

Equal fingerprints are merged first. A bounded sample shapes the top of a vantage-point tree whose
leaves hold about LEAF fingerprints; each leaf is a shard. A fingerprint lives in one shard (its home)
and also visits every shard whose region the triangle inequality can't rule out within the radius.
Of two shards only the later one's fingerprints visit the earlier, so each pair meets once. A shard
emits a spanning forest of its links, never all pairs, and the forests are joined by connected
components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow, small_batches
from dinefold.llm.components import connected_components
from dinefold.session import stored

WORD = re.compile(rb"[^ \t-\r]+")
SHINGLE = 3
SEED = 42
RADIUS = 3

#: Fingerprints of one shard, and of the sample that shapes the tree.
LEAF = 16384
SAMPLE = 16384
#: Cells of a distance matrix that are in memory at once.
CELLS = 1 << 21


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    count = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, -(-count // 65536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and `fp`, the fingerprint's bits as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t) for t in batch[text_col].to_pylist()], dtype=np.uint64)
        return {c: batch[c] for c in carry} | {"fp": fps.view(np.int64)}

    types = dict(df.dtypes)
    return in_arrow(df.select(*carry, text_col), run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), "fp long"]))


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(points: np.ndarray, rows: int, radius: int = RADIUS, leaf: int = LEAF):
    """A tree from a sample that stands for `rows` fingerprints.

    An inner node is (vantage point, bound, inside, outside), inside meaning a distance of at most bound;
    a leaf is its number, leaves are numbered from the left.
    """
    leaves = 0

    def node(own: np.ndarray):
        nonlocal leaves
        best = None
        if len(own) > 1 and rows * len(own) > leaf * len(points):
            for vantage in own[:: max(1, len(own) // 16)]:
                far = hamming(own, vantage).astype(np.int64)
                bound = int(np.median(far))
                inside = far <= bound
                if inside.all():
                    bound -= 1
                    inside = far <= bound
                if inside.any() and not inside.all():
                    # What both children would have to see.
                    cost = np.count_nonzero(far <= bound + radius) ** 2 + np.count_nonzero(far > bound - radius) ** 2
                    if best is None or cost < best[0]:
                        best = (cost, vantage, bound, inside)
        if best is None:
            leaves += 1
            return leaves - 1
        _, vantage, bound, inside = best
        return (vantage, bound, node(own[inside]), node(own[~inside]))

    return node(points)


def _walk(tree, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf that may hold a point within `slack` of a row; slack 0 gives the home."""
    rows, found = [], []
    todo = [(tree, np.arange(len(fps)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            rows.append(own)
            found.append(np.full(len(own), node, dtype=np.int32))
            continue
        vantage, bound, inside, outside = node
        far = hamming(fps[own], vantage).astype(np.int64)
        todo += [(inside, own[far <= bound + slack]), (outside, own[far > bound - slack])]
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.empty(0, np.int64), np.empty(0, np.int32))


def forest(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is within the radius of a home point; at most one per point and merge.

    Home points are sorted by their distance to a vantage point of the shard; a point is compared with
    those alone whose distance differs by no more than the radius.
    """
    a, b = [], []
    if not len(home):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    vantage = home[len(home) // 2]
    far = hamming(home, vantage).astype(np.int64)
    order = np.argsort(far, kind="stable")
    home, far = home[order], far[order]
    label = np.arange(len(home))

    def compare(part: np.ndarray, low: int, high: int, at_home: bool) -> None:
        row, col = np.nonzero(hamming(part[:, None], home[None, low:high]) <= radius)
        col += low
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(row)]):
            if at_home and e - s == 1:
                continue  # only itself
            groups = np.unique(label[col[s:e]])
            if not at_home:
                a.append(part[row[s]])
                b.append(home[groups[0]])
            for other in groups[1:]:
                a.append(home[groups[0]])
                b.append(home[other])
            if len(groups) > 1:
                label[np.isin(label, groups[1:])] = groups[0]

    for own, at_home in ((home, True), (visitors, False)):
        away = hamming(own, vantage).astype(np.int64)
        for d in np.unique(away):
            low, high = np.searchsorted(far, d - radius, "left"), np.searchsorted(far, d + radius, "right")
            same = own[away == d]
            step = max(1, CELLS // max(1, high - low))
            for k in range(0, len(same) if high > low else 0, step):
                compare(same[k : k + step], low, high, at_home)
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among distinct fingerprints (fp) that connect exactly the pairs within the radius."""
    spark = small_batches(distinct.sparkSession)
    rows = distinct.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1 << 30))
    share = int(min(1.0, SAMPLE / max(rows, 1)) * (1 << 30))
    sample = sorted(r["fp"] for r in distinct.where(draw < share).toLocalIterator())  # about SAMPLE numbers
    tree = grow(np.array(sample, dtype=np.int64).view(np.uint64), rows, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            home = np.empty(len(fps), dtype=np.int32)
            row, leaf = _walk(tree, fps, 0)
            home[row] = leaf
            row, leaf = _walk(tree, fps, radius)
            kept = leaf <= home[row]
            row, leaf = row[kept], leaf[kept]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[row].view(np.int64)), pa.array(leaf == home[row])], names=["leaf", "fp", "home"])

    def shard(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        a, b = forest(np.sort(fps[home]), np.sort(fps[~home]), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    routed = distinct.mapInArrow(route, "leaf int, fp long, home boolean")
    return routed.groupBy("leaf").applyInArrow(shard, "a long, b long")


def classes(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, component_id): a class of linked fingerprints and the smallest id of its documents."""
    first = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "fingerprints")
    root = connected_components(links(first.select("fp")))
    rooted = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of df.

    A null or empty text, or one of white space alone, has fingerprint 0 and is linked like any other.
    Rows without an id count as members of their class; a class without any id has a null component_id.
    Repeated rows fall into one class. An empty table gives no rows. Other columns are not read.
    """
    marked = stored(fingerprints(df), "simhash")
    return marked.join(classes(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
