"""Runs of words against a search of all periods, and what the report derives from them."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from dinefold.llm import runs
from tests.llm.helpers import DOCS, awkward, awkward_rows, clashing, empty


def brute(words, exponent=4, least=6):
    """Every stretch with a smallest period that no neighbour extends, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q if j > i else 0
            if length >= max(least, exponent * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append(runs.Run(i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r.start, r.period))


def texts(seed):
    rng = random.Random(seed)
    out = [[]]
    for _ in range(60):
        kind = rng.randrange(5)
        if kind == 0:
            w = [rng.choice("ab") for _ in range(rng.randrange(80))]
        elif kind == 1:
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            w = [rng.choice("abc") for _ in range(rng.randrange(5))] + unit * rng.randrange(2, 9) + unit[: rng.randrange(len(unit))]
        elif kind == 2:
            unit = ["a", "b"] * rng.randrange(1, 6) + ["c"]
            w = (unit * rng.randrange(1, 6) + ["d"]) * rng.randrange(1, 7)
        elif kind == 3:
            w = ["x"] * rng.randrange(30) + ["y"] * rng.randrange(12) + ["x"] * rng.randrange(30)
        else:
            w = [rng.choice("abcdefgh") for _ in range(rng.randrange(200))]
        out.append([c.encode() for c in w])
    fib = [b"a"], [b"a", b"b"]
    for _ in range(10):
        fib = fib[1], fib[1] + fib[0]
    return [*out, fib[1], [b"z"] * 700, [b"p", b"q", b"r"] * 150]


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5), (2, 9)])
@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found_once(seed, exponent, least):
    given = texts(seed)
    assert runs.runs_of(given, exponent, least) == [brute(w, exponent, least) for w in given]


def test_texts_of_a_batch_do_not_meet():
    """Equal texts side by side, and a text that begins as its neighbour ends."""
    given = [[b"a"] * 5, [b"a"] * 5, [b"a"] * 7, [b"a", b"b"] * 3, [b"a", b"b"] * 4]
    assert runs.runs_of(given) == [[], [], [runs.Run(0, 7, 1)], [], [runs.Run(0, 8, 2)]]


def test_a_long_periodic_text():
    unit = [str(i).encode() for i in range(700)]
    assert runs.runs_of([[b"head"] + unit * 60 + [b"tail"], [b"w"] * 50_000]) == [[runs.Run(1, 42_000, 700)], [runs.Run(0, 50_000, 1)]]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def report_row(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    own = brute(words)
    dropped = {i for r in own for i in range(r.start + r.period, r.start + r.length)}
    best = min(own, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(own), *(best or (None,) * 3), best and 1000 * best.length // best.period,
        sha("".join(f"{r.start},{r.length},{r.period}\n" for r in own).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_report_equals_the_definition(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(w.decode() for w in t) if i % 3 else "\t".join(w.decode() for w in t) + "\r\n", None, "s", 1) for i, t in enumerate(texts(1) + texts(2) + texts(4))]
    docs += [(5000 + i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(120))), "en", "s", 1) for i in range(120)]
    assert sum(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs) > 10
    got = runs.run_report(spark.createDataFrame(docs, DOCS).repartition(5))
    assert rows_of(got) == sorted((report_row(d[0], d[1]) for d in docs), key=repr)
    assert dict(got.dtypes)["exponent_milli"] == "bigint" and dict(got.dtypes)["n_runs"] == "bigint"


def test_awkward_rows(spark):
    got = runs.run_report(clashing(awkward(spark), "runs", "words", "h", "g", "a", "p", "best", "collapsed"))
    short = [(i, t) for i, t, *_ in awkward_rows() if len(t or "") < 2000]
    rows = rows_of(got)
    assert len(rows) == len(awkward_rows()) and all(report_row(i, t) in rows for i, t in short)
    assert runs.run_report(empty(spark)).collect() == []


def test_collapsed_text_of_the_operator(spark):
    df = spark.createDataFrame([(1, "so a b a b a b a b a end end"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.periodic_runs(df).collect()}
    assert got[1]["collapsed"] == "so a b end end" and got[1]["n_words"] == 12
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 9, 2)]
    assert got[2]["collapsed"] == "" and got[2]["runs"] == []
