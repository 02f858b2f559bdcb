"""The audit of filters against plain loops over all orders, and its lattice against enumeration."""

import math
import random
from itertools import permutations

import duckdb
import pytest

from dinefold.llm import filter_audit as fa
from tests.llm.helpers import DOCS, awkward_rows, clashing, empty, words

LABELS = "doc_id long, quality int, toxic int"


def failing(text: str, copy: bool) -> str:
    w = text.encode().split()
    out = "A" if len(w) < 200 else ""
    out += "B" if 100 * len(set(w)) < 50 * len(w) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    out += "D" if any(c in "#$%&*|" for c in text) else ""
    return out + ("E" if copy else "")


def brute(docs, labels):
    rows = []
    for doc_id, text, lang, *_ in docs:
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == (text or "") for o in docs)
        own = [(q, t) for i, q, t in labels if i is not None and i == doc_id]
        rows.append((lang or "", failing(text or "", copy), any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out, removed = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in rows if r[0] == part and before & set(r[1])]
                here = [r for r in rows if r[0] == part and not before & set(r[1]) and f in r[1]]
                out[part, order, step] = {
                    "kept": sum(r[0] == part for r in rows) - len(gone) - len(here),
                    "removed": len(here),
                    "redundant": sum(f in r[1] for r in gone),
                    "unique_fails": sum(r[0] == part and r[1] == f for r in rows),
                    "good_lost": sum(r[2] for r in here),
                    "toxic_lost": sum(r[3] for r in here),
                }
                removed[part, f] = removed.get((part, f), 0) + len(here)
    for (part, order, step), row in out.items():
        row["shapley"] = removed[part, order[step - 1]]
    return out


def sample():
    rng = random.Random(5)
    long = [words(rng, 220), words(rng, 220) + " #", words(rng, 30) * 8, words(rng, 230).upper(), words(rng, 10)]
    docs = [(1000 + i, rng.choice(long), rng.choice(["en", "de", None]), "s", None) for i in range(80)]
    docs += awkward_rows()
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs if rng.random() < 0.7]
    return docs, labels + labels[:5] + [(None, 1, 1), (-5, 1, 1)]


def found(spark, docs, labels):
    frame = clashing(spark.createDataFrame(docs, DOCS).repartition(4), "part", "mask", "n", "good", "digest", "state", "f")
    rows = fa.audit(fa.failure_masks(frame, spark.createDataFrame(labels, LABELS)), "ABCDE").collect()
    return {(r["part"], r["filter_order"], r["step"]): r for r in rows}, len(rows)


def test_every_order_equals_plain_loops(spark):
    docs, labels = sample()
    want = brute(docs, labels)
    got, n = found(spark, docs, labels)
    assert n == len(got) == 600 * 3 and got.keys() == want.keys()
    for key, row in want.items():
        assert {c: got[key][c] for c in row} == row, key
        assert got[key]["filter"] == key[1][key[2] - 1]


def test_no_rows_and_no_labels(spark):
    assert fa.audit(fa.failure_masks(empty(spark), spark.createDataFrame([], LABELS)), "ABCDE").collect() == []
    got, n = found(spark, [(1, None, None, None, None), (2, "", None, None, None)], [])
    assert n == 600 and got["", "EABCD", 1]["removed"] == 1 and got["", "EABCD", 2]["removed"] == 1
    assert got["", "AEBCD", 2]["redundant"] == 1 and got["", "AEBCD", 5]["kept"] == 0


def test_copies_of_one_text_and_repeated_rows(spark):
    """Half of all rows are one text; the rows that repeat its smallest id pass, all other copies fail."""
    text = "same " * 3
    docs = [(7, text, "en", "s", 1)] * 3 + [(7 + i, text, "en", "s", 1) for i in range(1, 400)] + [(None, text, "en", "s", 1)] * 2
    got, _ = found(spark, docs, [(7, 1, 0)])
    assert got["en", "EABCD", 1]["removed"] == 399 and got["en", "EABCD", 1]["kept"] == 5
    assert got["en", "EABCD", 2]["good_lost"] == 3


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6])
def test_path_counts_are_factorials(k):
    forward, backward = fa.path_counts(k)
    for s in range(1 << k):
        size = bin(s).count("1")
        assert forward[s] == math.factorial(size) and backward[s] == math.factorial(k - size)


def test_other_numbers_of_filters(spark):
    """The lattice takes any filters: three here, masks given by hand."""
    masks = spark.createDataFrame([("p", m, 10 + m, m, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = fa.audit(masks, "XYZ").collect()
    assert len(rows) == 18
    for r in rows:
        before = [1 << "XYZ".index(c) for c in r["filter_order"][: r["step"] - 1]]
        bit = 1 << "XYZ".index(r["filter"])
        assert r["removed"] == sum(10 + m for m in range(8) if m & bit and not any(m & b for b in before))
    assert sum(r["shapley_mean"] for r in rows if r["filter_order"] == "XYZ") == pytest.approx(sum(10 + m for m in range(1, 8)))
    with pytest.raises(ValueError):
        fa.audit(masks, "XX")


def test_oracle_agrees_on_awkward_rows(spark, tmp_path):
    docs, labels = sample()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}/*.parquet')")
    cursor = db.execute(fa.ORACLE)
    names = [c[0] for c in cursor.description]
    got, _ = found(spark, docs, labels)
    rows = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert len(rows) == len(got)
    for r in rows:
        assert got[r["part"], r["filter_order"], r["step"]].asDict() == pytest.approx(r)
