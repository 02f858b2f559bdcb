import math
import random

import numpy as np
from pyspark.sql import functions as F

from dinefold.llm import vp_search

SF = "/root/testdata/sf0.1"


def plain(rows, k=5):
    """Brute force over all pairs, in double precision."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for qi, q in ok:
        if qi % 50 == 0:
            found = sorted((-vp_search.cosines(q, v[None, :])[0], i) for i, v in ok if i != qi and len(v) == len(q))
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_exact_with_factor_one(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)]  # a very common vector
    rows += [(1200 + i, rows[i][1]) for i in range(20)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [1.0, None] * 4), (2200, [float("nan")] * 8), (2250, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2300, [1.0, 2.0]), (2301, [2.0, 1.0]), (2302, [1e200, 1e200]), (2303, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("rank", F.lit(1))
    vectors = vp_search.usable(df, "vec_id", "embedding")
    got = vp_search.nearest(vectors, vectors.where("vec_id % 50 = 0"), factor=1.0, shard_vectors=300).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain(rows)


def test_recall_of_the_default(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = vp_search.search_report(df).collect()
    want = plain([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert [r for r in sorted(map(tuple, got))] and len(got) == len(want)
    hit = {(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, _, i, _ in want}
    assert len(hit) / len(want) >= 0.95
    score = {(q, i): s for q, _, i, s in want}
    assert all(score[r["query_id"], r["vec_id"]] == r["score"] for r in got if (r["query_id"], r["vec_id"]) in score)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in vp_search.search_report(df).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert vp_search.search_report(df.limit(0)).count() == 0
