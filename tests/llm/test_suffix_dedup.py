import hashlib
import random

import numpy as np
import pytest

from dinefold.llm import suffix_dedup
from tests.llm.helpers import awkward, awkward_rows, clashing, empty, words


def plain(rows):
    """Brute force: every 100-byte string of every text in order."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_difference_cover(seed):
    rng = random.Random(seed)
    s = [rng.randint(1, rng.choice([1, 2, 3, 50, 1 << 22])) for _ in range(rng.randint(0, 200))]
    if seed % 3 == 0:
        s = s * 3
    got = suffix_dedup.difference_cover(np.array(s, dtype=np.int64))
    assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(rng):
    passage = words(rng, 40)
    texts = [words(rng, 50) for _ in range(15)]
    texts += [words(rng, rng.randint(0, 30)) + passage[rng.randint(0, 60) :] + words(rng, rng.randint(0, 30)) for _ in range(40)]
    texts += [texts[3], texts[4][:250], texts[5] + texts[6], "ab" * 200, "ba" * 150, "x" * 99, "x" * 100, "x" * 101, "é你" * 60, texts[20][:120] + "!" + texts[20][121:]]
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [2000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MAX_STRETCHES", most)
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRETCHES", 40)
    for seed in range(2):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), "doc_id long, text string").repartition(5)
        assert sorted(map(tuple, suffix_dedup.removal_report(df).collect())) == sorted(plain(rows))


def test_awkward(spark, tmp_path):
    clashing(awkward(spark), "row", "key", "spans").write.parquet(str(tmp_path / "in"))
    got = suffix_dedup.removal_report(spark.read.parquet(str(tmp_path / "in"))).collect()
    rows = sorted(((r[0], r[1]) for r in awkward_rows()), key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))
    assert suffix_dedup.removal_report(empty(spark)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    assert sorted(map(tuple, suffix_dedup.removal_report(docs).collect())) == want


def test_long_text_in_parts(monkeypatch):
    raw = words(random.Random(3), 4000).encode()
    whole = suffix_dedup.stretches(raw)
    monkeypatch.setattr(suffix_dedup, "SCAN", 1000)
    parts = suffix_dedup.stretches(raw)
    assert {(k, a) for k, a, b in zip(*whole)} <= {(k, a) for k, a, b in zip(*parts)}
    assert sum(parts[2] - parts[1] + 1) == len(raw) - 99
