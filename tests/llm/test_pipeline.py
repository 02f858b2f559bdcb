import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, clashing, empty
from tests.llm.test_layout import check_bins
from tests.llm.test_text_operators import lowered, plain_classes, plain_fingerprint, plain_spans

SF = "/root/testdata/sf0.001"
FILTERS = ["language_id", "exact_dedup", "simhash_near_dedup"]


def through(spark, docs, tmp_path):
    """Each stage's rows by name, written and read again in between."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
    return out


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = through(spark, docs, tmp_path)
    for name, df in list(got.items())[:-1]:
        assert df.dtypes == docs.dtypes, name
    assert docs.count() - got["language_id"].count() <= 1
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in list(got.items())[:-1]}

    last = {}
    for d, r in sorted(rows["language_id"].items()):
        last[lowered(r["text"])] = d
    assert set(rows["exact_dedup"]) == set(last.values())

    ids = sorted(rows["exact_dedup"])
    label = plain_classes([plain_fingerprint(rows["exact_dedup"][d]["text"]) for d in ids])
    assert set(rows["simhash_near_dedup"]) == {ids[c] for c in set(label.tolist())}

    assert set(rows["pii"]) == set(rows["simhash_near_dedup"])
    for d, r in rows["pii"].items():
        before = rows["simhash_near_dedup"][d]["text"]
        if not any(plain_spans(before).values()):
            assert r["text"] == before
        else:
            assert not any(v for k, v in plain_spans(r["text"]).items() if k == "email")
        assert r["n_chars"] == len(r["text"])
    lengths = {d: [len(r["text"].encode()) + 1] for d, r in rows["pii"].items()}
    check_bins(got["best_fit_packing"].collect(), lengths, (2048, 4096, 8192, 16384))


def test_run_equals_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = through(spark, docs, tmp_path)["best_fit_packing"]
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(last.collect())


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_documents(spark, tmp_path, make):
    clashing(make(spark), "_row", "score", "_key", "root").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    got = through(spark, docs, tmp_path)
    for name, df in list(got.items())[:-1]:
        assert sorted(df.dtypes) == sorted(docs.dtypes), name
    kept = got["exact_dedup"]
    assert kept.select(F.lower("text")).distinct().count() <= kept.count()
