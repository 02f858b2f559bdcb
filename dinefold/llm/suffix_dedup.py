"""Removal of bytes covered by a 100-byte string that also starts earlier, by suffix sorting.

1. Anchors. Of the 51 hashes of 50 bytes in a 100-byte string, the smallest (leftmost of equals) is its
   anchor. The anchor is decided by the string alone, so equal strings have equal anchors; neighbouring
   strings mostly share one, and the strings of one anchor's place form a stretch. Strings whose anchor
   occurs once in the corpus occur once; a bitmap of fixed size sorts most of them out.
2. Equal stretches are one group; all but the first are repeated as a whole. Two strings of one stretch
   are never equal, as their anchors lie at different distances. Stretches meet by a 128-bit digest, first
   inside an input partition, so that each partition sends a passage that very many documents share once.
3. Different stretches of one anchor share some strings and not others (the edges of a copy). Only for
   these the bytes are fetched, from the texts. They are dealt by anchor to buckets, and each bucket is
   sorted by the difference-cover algorithm: sampled triples are sorted and named, the names are sorted by
   recursion, the remaining suffixes are merged, and the 100-byte prefixes of adjacent suffixes are
   compared. Of equal prefixes all but the first are repeated.
4. An anchor with more than MAX_STRETCHES different stretches (the edge of a passage that very many
   documents share) would fill a bucket. Its strings meet by a 128-bit digest instead, combined before
   the shuffle, which gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow, key_filter, may_hold, small_batches
from dinefold.session import stored

LENGTH = 100
GRAM = 50
MAX_STRETCHES = 2000
#: Stretches of one bucket, on average.
BUCKET_STRETCHES = 10000
#: The filter of repeated anchors that every task gets has 2^26 bits, 8 MB, whatever the input.
ANCHOR_BITS = 26
#: At most 2^20 groups of anchors; there are about as many as input partitions.
GROUP_BITS = 20

LETTERS = np.random.default_rng(991).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x5851F42D4C957F2D
#: Positions in the low bits of a sort key; longer texts are scanned in parts.
PLACE_BITS = np.uint64(24)
SCAN = 1 << 22


@lru_cache(maxsize=1)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    row = np.full(size, BASE, dtype=np.uint64)
    row[0] = 1
    power = np.multiply.accumulate(row)
    row[1:] = pow(BASE, -1, 1 << 64)
    return power, np.multiply.accumulate(row)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n at least."""
    return _power_table(max(SCAN // 2, 1 << (n - 1).bit_length()))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the GRAM bytes at each place."""
    n = len(data)
    power, inverse = _powers(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(LETTERS[data] * power[:n], out=run[1:])
    h = (run[GRAM:] - run[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash and the anchor's place for each 100-byte string of the bytes."""
    h = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, goal = 1, LENGTH - GRAM + 1
    while width < goal:
        step = min(width, goal - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    place = (key & low).astype(np.int64)
    return h[place].view(np.int64), place


def stretches(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of each stretch of 100-byte strings of a text."""
    found = []
    for begin in range(0, max(0, len(raw) - LENGTH + 1), SCAN):
        key, place = _block(np.frombuffer(raw, dtype=np.uint8)[begin : begin + SCAN + LENGTH - 1])
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        found.append((key[first], first + begin, last + begin))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def stretches_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, anchor hash, first start, last start) for the texts; short ones are scanned together."""
    found = [(np.empty(0, np.int64),) * 4]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    block = np.where(sizes < LENGTH, -1, np.cumsum(sizes) // (SCAN // 4))
    for at in range(len(texts)):
        if sizes[at] > SCAN // 4:
            key, first, last = stretches(texts[at])
            found.append((np.full(len(key), at), key, first, last))
            block[at] = -1
    for b in np.unique(block[block >= 0]):
        own = np.flatnonzero(block == b)
        begins = np.cumsum(sizes[own]) - sizes[own]
        key, place = _block(np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8))
        of = np.repeat(np.arange(len(own)), sizes[own])[: len(key)]
        start = np.arange(len(key)) - begins[of]
        inside = np.flatnonzero(start + LENGTH <= sizes[own][of])
        first = np.flatnonzero(np.diff(place[inside], prepend=-1) | np.diff(of[inside], prepend=-1))
        last = inside[np.append(first[1:], len(inside)) - 1]
        first = inside[first]
        found.append((own[of[first]], key[first], start[first], start[last]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row, in the order of the columns' values; all of them are below 2^31."""
    key, top = columns[0], int(columns[0].max(initial=0))
    for column in columns[1:]:
        bits = max(1, int(column.max(initial=0)).bit_length())
        if top.bit_length() + bits > 63:
            kinds, key = np.unique(key, return_inverse=True)
            top = len(kinds)
        key = (key << bits) | column
        top = (top << bits) | ((1 << bits) - 1)
    return key


def difference_cover(s: np.ndarray) -> np.ndarray:
    """The suffix array of s, whose values are positive, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    # Sort the sampled triples and name them.
    triple = _joined(t[sampled], t[sampled + 1], t[sampled + 2])
    order = np.argsort(triple)
    new = np.diff(triple[order], prepend=-1) != 0
    names = np.empty(len(sampled), dtype=np.int64)
    names[order] = np.cumsum(new)
    # Names that repeat are sorted by recursion.
    if not new.all():
        order = difference_cover(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    cover = sampled[order]
    cover = cover[cover < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_joined(t[rest], rank[rest + 1]))]
    # Merge: a remaining suffix comes after those of ones with a smaller (value, rank of the next) and
    # those of twos with a smaller (value, value, rank of the second next).
    one, two = cover[cover % 3 == 1], cover[cover % 3 == 2]
    k = len(rest)
    by_one = _joined(np.append(t[rest], t[one]), np.append(rank[rest + 1], rank[one + 1]))
    both = np.append(rest, two)
    by_two = _joined(t[both], t[both + 1], rank[both + 2])
    at = np.searchsorted(by_one[k:], by_one[:k]) + np.searchsorted(by_two[k:], by_two[:k]) + np.arange(k)
    out = np.empty(n, dtype=np.int64)
    out[at] = rest
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = cover
    return out


def repeated_starts(parts: list[bytes], before: np.ndarray) -> list[np.ndarray]:
    """For each stretch, the starts in it whose string occurs in another one that comes first in `before`."""
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(int(sizes.sum()) + len(parts), dtype=np.int64)
    flat = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    text[:] = flat.astype(np.int64) + 1 + len(parts)
    text[begins + sizes] = np.arange(1, len(parts) + 1)  # an end of its own for each
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    order = difference_cover(text)
    order = order[order + LENGTH <= (begins + sizes)[owner[order]]]
    # Adjacent prefixes, compared eight bytes at a time.
    words = np.ndarray((max(0, len(flat) - 7),), dtype=np.uint64, buffer=flat, strides=(1,)).copy()
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        word = words[order + k]
        same[1:] &= word[1:] == word[:-1]
    group = np.cumsum(~same)
    first = np.lexsort((before[owner[order]], group))
    repeat = np.ones(len(order), dtype=bool)
    repeat[first[np.diff(group[first], prepend=0) != 0]] = False
    hit = order[repeat]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(parts)
    by = np.argsort(owner[hit], kind="stable")
    hit = hit[by]
    cuts = np.flatnonzero(np.diff(owner[hit])) + 1
    for own in np.split(hit, cuts) if len(hit) else []:
        k = owner[own[0]]
        out[k] = np.sort(own - begins[k])
    return out


def covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of bytes that strings at ascending starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(starts, cut)]


def _mixed(key: np.ndarray) -> np.ndarray:
    """Anchor hashes are the least of many; spread them over all 64 bits."""
    key = key.view(np.uint64)
    return (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _by_partition(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function from all batches of a partition to tables. A partition of a scan is
    bounded by spark.sql.files.maxPartitionBytes, and what is kept of it by its text."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: (b for t in fn(batches) for b in t.to_batches()), schema)


def _cut(group: np.ndarray) -> list[tuple[int, slice]]:
    """(value, slice) for each run of equal values in a sorted array."""
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group)) if len(group) else np.empty(0, np.int64)
    return [(int(group[a]), slice(a, z)) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _anchor_bits(df: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of anchors that occur at two places of the corpus at least (and a few others).

    Each partition sends the 32 bits after the group's for each of its anchors, twice where it has more.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        seen = [np.empty(0, np.int64)]
        for batch in batches:
            seen.append(stretches_of([(t or "").encode() for t in batch["text"].to_pylist()])[1])
        key = np.sort(_mixed(np.concatenate(seen)))
        third = np.zeros(len(key), dtype=bool)
        third[2:] = key[2:] == key[:-2]
        key = key[~third]
        cell = (key << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        runs = _cut((key >> np.uint64(64 - bits)).astype(np.int64))
        yield pa.table({"bucket": pa.array([g for g, _ in runs], pa.int32()), "cells": pa.array([cell[w].tobytes() for _, w in runs], pa.binary())})

    def repeated(group: pa.Table) -> pa.Table:
        cell = np.sort(np.frombuffer(b"".join(group["cells"].to_pylist()), dtype=np.uint32))
        flags = np.zeros(1 << (ANCHOR_BITS - bits), dtype=bool)
        flags[cell[1:][cell[1:] == cell[:-1]] >> np.uint32(32 - ANCHOR_BITS + bits)] = True
        return pa.table({"bucket": group["bucket"][:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    found = _by_partition(df.select("text"), send, "bucket int, cells binary").groupBy("bucket").applyInArrow(repeated, "bucket int, flags binary")
    out = np.zeros((1 << bits, (1 << (ANCHOR_BITS - bits)) // 8), dtype=np.uint8)
    got = found.toArrow()  # 8 MB at most, by ANCHOR_BITS
    for bucket, flags in zip(got["bucket"].to_pylist(), got["flags"].to_pylist()):
        out[bucket] = np.frombuffer(flags, dtype=np.uint8)
    return out.ravel()


#: What a partition sends of a stretch. Earlier: the smaller id, then the earlier start; no id comes last.
SENT = {"key": np.uint64, "d1": np.uint64, "d2": np.uint64, "n": np.uint8, "doc_id": np.int64, "row": np.int64, "start": np.int32, "size": np.uint8}
FOUND = "row long, span long, key long, kinds long, n boolean, doc_id long"


def _earlier(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): stretches by digest and then from the first to the last, and where a digest begins."""
    order = np.lexsort((x["start"], x["row"], x["doc_id"], x["n"], x["d2"], x["d1"]))
    new = np.ones(len(order), dtype=bool)
    d1, d2 = x["d1"][order], x["d2"][order]
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    return order, new


def _span(x: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Start and end of stretches in one number: start in the high 32 bits."""
    start = x["start"][at].astype(np.int64)
    return start << 32 | start + x["size"][at]


def equal_stretches(df: DataFrame) -> DataFrame:
    """(row, span): stretches that also occur earlier. With a key: the first of each of the `kinds` different
    stretches of one anchor."""
    spark = df.sparkSession
    bits = min(GROUP_BITS, max(6, (df.rdd.getNumPartitions() - 1).bit_length()))
    bitmap = spark.sparkContext.broadcast(_anchor_bits(df, bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        parts: dict[str, list] = {c: [np.empty(0, t)] for c, t in SENT.items()}
        for batch in batches:
            raws = [(t or "").encode() for t in batch["text"].to_pylist()]
            of, key, first, last = stretches_of(raws)
            key = _mixed(key)
            bit = (key >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)
            hit = np.flatnonzero(bitmap.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            of, key, first, last = of[hit], key[hit], first[hit], last[hit]
            digests = b"".join(hashlib.blake2b(raws[i][a : b + LENGTH], digest_size=16).digest() for i, a, b in zip(of.tolist(), first.tolist(), last.tolist()))
            d = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)
            doc = batch["doc_id"]
            doc_id, row = doc.fill_null(0).to_numpy(zero_copy_only=False), batch["row"].to_numpy(zero_copy_only=False)
            none = doc.is_null().to_numpy(zero_copy_only=False)
            for c, v in zip(SENT, (key, d[:, 0], d[:, 1], none[of], doc_id[of], row[of], first, last - first + LENGTH)):
                parts[c].append(v.astype(SENT[c]))
        x = {c: np.concatenate(v) for c, v in parts.items()}
        order, new = _earlier(x)
        again = order[~new]
        least = np.sort(order[new])
        bucket = (x["key"][least] >> np.uint64(64 - bits)).astype(np.int64)
        least, bucket = least[by := np.argsort(bucket, kind="stable")], bucket[by]
        runs = _cut(bucket)
        packed = [b"".join(x[c][least[w]].tobytes() for c in SENT) for _, w in runs]
        yield pa.table({"bucket": pa.array([g for g, _ in runs], pa.int32()), "sent": pa.array(packed, pa.binary()), "row": pa.nulls(len(runs), pa.int64()), "spans": pa.nulls(len(runs), pa.binary())})
        # Repeats inside the partition are decided; they only pass through.
        again = again[np.lexsort((x["start"][again], x["row"][again]))]
        runs = _cut(x["row"][again])
        spans = [_span(x, again[w]).tobytes() for _, w in runs]
        rows = np.array([r for r, _ in runs], dtype=np.int64)
        yield pa.table({"bucket": pa.array(rows & ((1 << bits) - 1), pa.int32()), "sent": pa.nulls(len(runs), pa.binary()), "row": pa.array(rows, pa.int64()), "spans": pa.array(spans, pa.binary())})

    def decide(group: pa.Table) -> pa.Table:
        parts: dict[str, list] = {c: [np.empty(0, t)] for c, t in SENT.items()}
        width = sum(np.dtype(t).itemsize for t in SENT.values())
        rows, spans = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for sent, row, own in zip(*(group[c].to_pylist() for c in ("sent", "row", "spans"))):
            if sent is None:
                spans.append(np.frombuffer(own, dtype=np.int64))
                rows.append(np.full(len(spans[-1]), row))
                continue
            count, at = len(sent) // width, 0
            for c, t in SENT.items():
                parts[c].append(np.frombuffer(sent, dtype=t, count=count, offset=at))
                at += count * np.dtype(t).itemsize
        x = {c: np.concatenate(v) for c, v in parts.items()}
        order, new = _earlier(x)
        again, least = order[~new], order[new]
        rows.append(x["row"][again])
        spans.append(_span(x, again))
        row, span = np.concatenate(rows), np.concatenate(spans)
        _, of, kinds = np.unique(x["key"][least], return_inverse=True, return_counts=True)
        edge = least[kinds[of] > 1]
        none = len(row)
        columns = [
            pa.array(np.append(row, x["row"][edge]), pa.int64()),
            pa.array(np.append(span, _span(x, edge)), pa.int64()),
            pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(x["key"][edge].view(np.int64))]),
            pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(kinds[of][kinds[of] > 1], pa.int64())]),
            pa.concat_arrays([pa.nulls(none, pa.bool_()), pa.array(x["n"][edge].astype(bool))]),
            pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(x["doc_id"][edge], pa.int64())]),
        ]
        return pa.table(columns, names=["row", "span", "key", "kinds", "n", "doc_id"])

    sent = _by_partition(df, send, "bucket int, sent binary, row long, spans binary")
    return stored(sent.groupBy("bucket").applyInArrow(decide, FOUND), "stretches")


def _with_text(docs: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs joined with `keyed` (row and more), and the docs that surely have no row there; only the texts of
    the first are shuffled."""
    keyed = keyed.withColumnRenamed("row", "key")
    bitmap = stored(key_filter(keyed), "row-filter")
    rows = docs.withColumnRenamed("row", "key")
    return may_hold(rows, bitmap, True).join(keyed, "key", "left").withColumnRenamed("key", "row"), may_hold(rows, bitmap, False).withColumnRenamed("key", "row")


def repeats(df: DataFrame) -> DataFrame:
    """(row, span): bytes to remove, from df (row, doc_id, text); spans of a row may overlap."""
    found = equal_stretches(df)
    whole = found.where("key is null").select("row", "span")
    wanted = found.where("key is not null").groupBy("row").agg(F.collect_list(F.struct("span", "key", "kinds")).alias("edges"))

    def cut(batch: pa.RecordBatch) -> dict:
        rows = {c: [] for c in ("key", "kinds", "first", "bytes")}
        for doc, row, text, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "text", "edges"))):
            raw = (text or "").encode() if own else b""
            for e in own or []:
                start, end = e["span"] >> 32, e["span"] & 0xFFFFFFFF
                rows["key"].append(e["key"])
                rows["kinds"].append(e["kinds"])
                rows["first"].append({"n": doc is None, "doc_id": doc, "row": row, "start": start})
                rows["bytes"].append(raw[start:end])
        return rows

    texts, _ = _with_text(df, wanted)
    cuts = in_arrow(texts.select("doc_id", "row", "text", "edges"), cut, "key long, kinds long, first struct<n: boolean, doc_id: long, row: long, start: long>, bytes binary")
    edges = stored(cuts, "edges")
    total = edges.where(F.col("kinds") <= MAX_STRETCHES).count()
    buckets = max(1, -(-total // BUCKET_STRETCHES))

    def bucket(group: pa.Table) -> pa.Table:
        first = group["first"].combine_chunks()
        fields = [first.field(c).to_numpy(zero_copy_only=False) for c in ("start", "row")]
        fields += [first.field("doc_id").fill_null(0).to_numpy(zero_copy_only=False), first.field("n").to_numpy(zero_copy_only=False)]
        before = np.empty(len(first), dtype=np.int64)
        before[np.lexsort(fields)] = np.arange(len(first))
        found = repeated_starts(group["bytes"].to_pylist(), before)
        spans = [(r, s + a << 32 | s + b) for r, s, own in zip(fields[1].tolist(), fields[0].tolist(), found) for a, b in covered(own)]
        return pa.table([pa.array([x[i] for x in spans], pa.int64()) for i in range(2)], names=["row", "span"])

    dealt = edges.where(F.col("kinds") <= MAX_STRETCHES).withColumn("bucket", F.pmod("key", F.lit(buckets))).drop("key", "kinds")
    sorted_ = dealt.groupBy("bucket").applyInArrow(bucket, "row long, span long")

    def strings(batch: pa.RecordBatch) -> dict:
        rows = {c: [] for c in ("digest", "n", "doc_id", "row", "start")}
        for first, part in zip(batch["first"].to_pylist(), batch["bytes"].to_pylist()):
            count = len(part) - LENGTH + 1
            rows["digest"] += [hashlib.blake2b(part[i : i + LENGTH], digest_size=16).digest() for i in range(count)]
            for c in ("n", "doc_id", "row"):
                rows[c] += [first[c]] * count
            rows["start"] += range(first["start"], first["start"] + count)
        return rows

    crowded = in_arrow(edges.where(F.col("kinds") > MAX_STRETCHES).select("first", "bytes"), strings, "digest binary, n boolean, doc_id long, row long, start long")
    crowded = stored(crowded, "crowded")
    least = crowded.groupBy("digest").agg(F.min(F.struct("n", "doc_id", "row", "start")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    single = crowded.join(least, "digest").where("row <> least.row or start <> least.start").select("row", (F.shiftleft("start", 32) + F.col("start") + LENGTH).alias("span"))
    return whole.unionByName(sorted_).unionByName(single)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal runs."""
    out: list[list[int]] = []
    for a, b in ((s >> 32, s & 0xFFFFFFFF) for s in sorted(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removal_report(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of df.

    Null counts as empty; texts of fewer than 100 bytes lose nothing. Rows that repeat an id are documents
    of their own, the one read first is the earlier. Row numbers are given once and written with the texts;
    all steps read the written table. An empty table gives no rows.
    """
    docs = stored(df.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
    # Spans of one row are at most two for each of its stretches.
    spans = stored(repeats(docs).groupBy("row").agg(F.collect_list("span").alias("spans")), "repeats")
    hit, rest = _with_text(docs, spans)
    rest = rest.withColumn("spans", F.lit(None).cast("array<long>"))

    def run(batch: pa.RecordBatch) -> dict:
        rows = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, own in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            raw, runs, kept, last = (text or "").encode(), merged(own or []), hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[last:a])
                last = b
            kept.update(raw[last:])
            rows["n_bytes"].append(len(raw))
            rows["n_removed"].append(sum(b - a for a, b in runs))
            rows["n_spans"].append(len(runs))
            rows["kept_sha256"].append(kept.hexdigest())
        return {"doc_id": batch["doc_id"]} | rows

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return in_arrow(hit.select("doc_id", "text", "spans"), run, schema).unionByName(in_arrow(rest.select("doc_id", "text", "spans"), run, schema))
