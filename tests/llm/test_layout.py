import random
import zlib

import numpy as np
import pytest

from dinefold.llm import packing, shuffle_shards
from tests.llm.helpers import awkward, awkward_rows, clashing, empty


def test_shards(spark, tmp_path):
    df = clashing(awkward(spark), "shard", "slot", "bucket")
    back = shuffle_shards.shuffle_to_shards(df, str(tmp_path / "s"), shards=4, bucket_bytes=3000)
    assert {"in_shard", "in_slot", "bucket", "shard", "slot"} <= set(back.columns)
    rows = back.collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in rows))) == sorted(map(str, ((a, b, c, e) for a, b, c, _, e in awkward_rows())))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == [0, 1, 2, 3] and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shuffle_shards.shuffle_to_shards(empty(spark), str(tmp_path / "e")).count() == 0


def test_shard_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = shuffle_shards.shard_report(docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    # Neighbours of the input don't stay neighbours.
    assert np.mean(np.abs(np.diff(order)) == 1) < 0.05
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_shards.shard_report(docs.repartition(9)).collect()}
    assert other == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_shards.shard_report(docs, seed=8).collect()} != other


def test_fisher_yates_is_uniform():
    seen = {}
    for seed in range(6000):
        key = tuple(shuffle_shards.fisher_yates(3, seed))
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 850


def plain_fill(lengths, opened, sizes):
    """Best fit by plain loops over all open bins: (bin, offset) of each length, final size of each bin."""
    bins, out = [], []
    for length, size in zip(lengths, opened, strict=True):
        fits = [b for b in bins if b[0] - b[1] >= length]
        if fits:
            room = min(b[0] - b[1] for b in fits)
            b = max((x for x in fits if x[0] - x[1] == room), key=lambda x: x[2])
        else:
            b = [size, 0, 0, len(bins)]
            bins.append(b)
        out.append((b[3], b[1]))
        b[1] += length
        b[2] = len(out)
    return out, [min(s for s in sizes if s >= b[1]) for b in bins]


def plain_search(lengths, sizes, classes, rounds):
    """The layout of the plan that the rules of the docstring arrive at."""
    up = sorted(lengths)
    ends = sorted({up[i * (len(up) - 1) // classes] for i in range(1, classes)})
    kind = [sum(e < x for e in ends) for x in lengths]
    fit = [min(s for s in sizes if s >= x) for x in lengths]
    total = lambda found: sum(packing.cost(c) for c in found[1])
    layout = lambda plan: plain_fill(lengths, [max(f, plan[k]) for f, k in zip(fit, kind, strict=True)], sizes)
    plan = [0] * (max(kind) + 1)
    best, seen = layout(plan), None
    for _ in range(rounds):
        if seen == total(best):
            break
        seen = total(best)
        for k in range(len(plan)):
            for size in sizes:
                found = layout(plan[:k] + [size] + plan[k + 1 :])
                if total(found) < total(best):
                    plan, best = plan[:k] + [size] + plan[k + 1 :], found
    return best


@pytest.mark.parametrize("seed", range(8))
def test_pack_equals_plain_loops(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, rng.choice([10, 40, 64])) for _ in range(120)), reverse=True)
    bins, offsets, size = packing.pack(np.array(lengths), (16, 32, 64), classes=4)
    placed, final = plain_search(lengths, (16, 32, 64), 4, packing.ROUNDS)
    assert list(zip(bins.tolist(), offsets.tolist())) == placed
    assert size.tolist() == [final[b] for b in bins]


def test_lengths_are_chosen_jointly():
    """Pieces just over half of the smallest length share a longer bin: cheaper than the smallest fit, full lengths stay."""
    sizes = (2048, 4096, 8192, 16384)
    for lengths in ([1300] * 300, [2048] * 50 + [1100] * 90 + [10] * 5, [5000] * 40 + [1300] * 40):
        bins, _, size = packing.pack(np.array(lengths), sizes)
        total = sum(packing.cost(int(c)) for c in dict(zip(bins.tolist(), size.tolist())).values())
        smallest = plain_fill(lengths, [min(s for s in sizes if s >= x) for x in lengths], sizes)[1]
        assert total < 0.95 * sum(packing.cost(c) for c in smallest)
    assert set(packing.pack(np.array([2048] * 20), sizes)[2]) == {2048}


def check_bins(rows, lengths, sizes):
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in own:
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["bin_size"] for r in own} == {min(s for s in sizes if s >= at)}
    for doc, own in docs.items():
        assert sum(r["length"] for r in own) == sum(lengths[doc])
    assert set(docs) == set(lengths)
    return sum(x["length"] for x in rows) / sum(own[0]["bin_size"] for own in bins.values())


def test_best_fit(spark):
    df = clashing(awkward(spark), "bin_id", "piece", "_group", "_n")
    rows = packing.best_fit(df, packing.byte_tokens(), sizes=(64, 256, 1024), group_pieces=20).collect()
    lengths = {}
    for doc, text, *_ in awkward_rows():
        lengths.setdefault(doc, []).append(len((text or "").encode()) + 1)
    check_bins(rows, lengths, (64, 256, 1024))
    for r in rows:
        assert r["piece_start"] == r["piece"] * 1024
    assert packing.best_fit(empty(spark), packing.byte_tokens()).count() == 0


def test_best_fit_fills_bins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.best_fit(docs, packing.byte_tokens()).collect()
    lengths = {r["doc_id"]: [r["n"]] for r in docs.selectExpr("doc_id", "octet_length(text) + 1 as n").collect()}
    assert check_bins(rows, lengths, packing.SIZES) > 0.97
