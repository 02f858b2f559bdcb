"""Row numbers must survive a scan that packs its files in another way from one job to the next."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dinefold import session
from dinefold.llm import suffix_dedup, tree_dedup
from tests.llm.helpers import DOCS, words
from tests.llm.test_text_operators import lowered

PACKED = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def repacked(spark, monkeypatch):
    """After each written step, scans pack files into partitions of another size."""
    sizes = ["3k", "6k", "4k", "128m", "5k"]
    before = spark.conf.get(PACKED)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set(PACKED, "128m")

    def stored(df, purpose):
        out = session.stored(df, purpose)
        sizes.append(sizes.pop(0))
        spark.conf.set(PACKED, sizes[-1])
        return out

    for module in (corpus_pipeline, suffix_dedup, tree_dedup, corpus_pipeline.vp_simhash):
        monkeypatch.setattr(module, "stored", stored)
    yield
    spark.conf.set(PACKED, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def documents(spark, path):
    rng = random.Random(11)
    base = [words(rng, 60) for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else words(rng, 60), "en", "s", 1) for i in range(120)]
    spark.createDataFrame(rows, DOCS).repartition(9, F.col("doc_id")).write.parquet(path)
    return rows, spark.read.parquet(path)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup])
def test_dedup_keeps_the_decided_rows(spark, tmp_path, repacked, stage):
    rows, docs = documents(spark, str(tmp_path / "docs"))
    pick = max if stage is corpus_pipeline.exact_dedup else min
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(lowered(t), []).append(d)
    kept = sorted(r["doc_id"] for r in stage(spark, docs, "").collect())
    assert kept == sorted(pick(own) for own in ids.values())


def test_suffix_dedup_cuts_the_decided_rows(spark, tmp_path, repacked):
    rows, docs = documents(spark, str(tmp_path / "docs"))
    seen, want = set(), {}
    for d, t, *_ in rows:
        raw = t.encode()
        again = t in seen and len(raw) >= 100
        seen.add(t)
        want[d] = hashlib.sha256(b"" if again else raw).hexdigest()
    assert {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.removal_report(docs).collect()} == want
