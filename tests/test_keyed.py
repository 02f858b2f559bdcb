"""The keyed store against a dictionary: merged runs, replays, broken loads."""

from __future__ import annotations

import os
import random

import pytest

from dinefold.sources import keyed

SCHEMA = "k string, n int, v int, t int"


def store(spark, path):
    return keyed.KeyedStore(spark, str(path), ["k", "n"], ["t"], buckets=2)


def test_runs_shrink_and_rows_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(5), {}
    kept = store(spark, tmp_path)
    for i in range(9):
        rows = [(rng.choice("abcdefgh"), rng.choice([None, 1, 2]), rng.randrange(99), t) for t in rng.sample(range(50), rng.randrange(1, 12))]
        kept.load(spark.createDataFrame(rows, SCHEMA), i)
        for k, n, v, t in sorted(rows, key=lambda r: r[3]):
            want[k, n] = (v, t)
        sizes = [r["rows"] for r in kept.manifest()["runs"]]
        assert all(a >= keyed.RATIO * b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[0] <= len(want)
    assert sorted(((r["k"], r["n"]), (r["v"], r["t"])) for r in kept.read().collect() if r["n"]) == sorted(x for x in want.items() if x[0][1])
    assert kept.read().count() == len(want)
    (k, n), (v, t) = next(x for x in want.items() if x[0][1] is None)
    found = kept.lookup(k, n)
    assert [tuple(r) for r in found.collect()] == [(k, n, v, t)]
    assert "key_bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1][:200]
    # Folders and manifests of earlier loads are gone.
    assert len([f for f in os.listdir(tmp_path / "manifests") if f.endswith(".json")]) == keyed.KEPT_MANIFESTS
    assert len(os.listdir(tmp_path / "runs")) <= 2 * len(kept.manifest()["runs"]) + 2


def test_replays_empty_batches_and_new_columns(spark, tmp_path):
    kept = store(spark, tmp_path)
    with pytest.raises(ValueError):
        kept.read()
    kept.load(spark.createDataFrame([], SCHEMA), 0)
    kept.load(spark.createDataFrame([("a", 1, 5, 1)], SCHEMA), 1)
    before = kept.manifest()
    kept.load(spark.createDataFrame([("a", 1, 6, 9)], SCHEMA), 1)  # a replay, whatever it holds
    assert kept.manifest() == before
    kept.load(spark.createDataFrame([("b", 1, 7, 0, "x")], SCHEMA + ", extra string"), 2)
    assert sorted((r["k"], r["v"], r["extra"]) for r in kept.read().collect()) == [("a", 5, None), ("b", 7, "x")]


def test_load_that_breaks_off_is_invisible(spark, tmp_path, monkeypatch):
    kept = store(spark, tmp_path)
    kept.load(spark.createDataFrame([("a", 1, 5, 1)], SCHEMA), 0)

    def lost(self, manifest):
        raise OSError("driver lost")

    newer = spark.createDataFrame([("a", 1, 8, 2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedStore, "_publish", lost)
        with pytest.raises(OSError):
            kept.load(newer, 1)
    assert [r["v"] for r in kept.read().collect()] == [5]
    kept.load(newer, 1)
    assert [r["v"] for r in kept.read().collect()] == [8]
    named = {r["folder"] for r in kept.manifest()["runs"]}
    assert named <= {f"runs/{f}" for f in os.listdir(tmp_path / "runs")} and len(os.listdir(tmp_path / "runs")) <= 2
