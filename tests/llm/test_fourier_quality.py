"""Quality scores: sums against direct ones, calibration against search, and accuracy on labels held out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dinefold.llm import fourier_quality as fq
from tests.llm.helpers import awkward, awkward_rows, clashing, empty, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.randint(20, 200), "abcdefghijklmnopqrst")
        if not good:
            text = rng.choice([text.upper() + "!!", " | ".join(text.split()), text.replace(" ", "### "), " ".join(text.split()[:1] * 60)])
        docs.append((i, text, None, None, None))
        labels.append((i, int(good), 0))
    return docs, labels


def test_partition_sums_equal_direct_sums(spark):
    docs, labels = corpus(300)
    x = np.array([fq.statistics(d[1]) for d in docs], float)
    y = np.array([q for _, q, _ in labels])
    fold = np.arange(len(y)) % 3
    fourier = fq.Fourier(x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1), features=20)
    rows = spark.createDataFrame([(r.tolist(), int(a), int(b)) for r, a, b in zip(x, y, fold)], "stats array<float>, y int, fold int").repartition(7)
    sums = fq.normal_equations(rows, fourier)
    m = np.hstack([fourier(x), y[:, None]])
    for f in range(3):
        own = m[fold == f]
        assert np.allclose(sums[f], own.T @ own)
    w = fq.ridge(sum(sums.values()), 1e-3)
    a = m[:, :-1].T @ m[:, :-1] + 1e-3 * len(m) * np.diag([0] + [1] * 20)
    assert np.allclose(a @ w, m[:, :-1].T @ y)
    assert fq.squared_error(sums[0], w) == pytest.approx(((fourier(x[fold == 0]) @ w - y[fold == 0]) ** 2).sum())


def test_features_approximate_the_gaussian_kernel():
    x = np.random.default_rng(1).normal(size=(40, fq.STATISTICS))
    fourier = fq.Fourier(np.zeros(fq.STATISTICS), np.ones(fq.STATISTICS), features=20_000, width=1.0)
    z = fourier(x)[:, 1:]
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * fq.STATISTICS))).max() < 0.05


def test_isotonic_is_the_nearest_rising_sequence():
    rng = np.random.default_rng(4)
    for _ in range(20):
        v, w = rng.random(9), rng.integers(1, 5, 9).astype(float)
        got = fq.isotonic(v, w)
        # The max-min formula of isotonic regression.
        mean = lambda a, b: (v[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
        assert np.allclose(got, want)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    rows = fq.quality_report(frame, spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(docs) and 120 < len(held) < 240
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    # Labels of held-out documents change nothing, nor do language and source.
    ids = {r["doc_id"] for r in held}
    flipped = [(i, 1 - q if i in ids else q, t) for i, q, t in labels]
    again = fq.quality_report(frame.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}), spark.createDataFrame(flipped, LABELS)).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in rows} == {r["doc_id"]: round(r["score"], 9) for r in again}


def test_awkward_rows(spark):
    docs, labels = corpus(200)
    more = [(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0), (9999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").unionByName(awkward(spark))
    rows = fq.quality_report(clashing(frame, "stats", "y", "fold", "score", "quality"), spark.createDataFrame(labels + more, LABELS)).collect()
    assert len(rows) == 200 + len(awkward_rows()) and all(np.isfinite(r["score"]) for r in rows)
    assert fq.quality_report(empty(spark), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("quality,want", [([], 0.5), ([1, 1, 1], 1.0), ([0, 0, 0], 0.0)])
def test_too_few_labels(spark, quality, want):
    ids = [i for i in range(1, 40)]
    frame = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i in ids for q in quality], LABELS)
    assert {r["score"] for r in fq.quality_report(frame, labels).collect()} == {want}
