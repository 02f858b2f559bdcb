import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dinefold.llm import chunk_bpe
from dinefold.llm.bpe import UnitEncoder
from tests.llm.helpers import awkward, awkward_rows, clashing, empty, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return UnitEncoder(PATH)


def test_rolling_hash_equals_the_sum():
    data = np.frombuffer(random.Random(1).randbytes(300), dtype=np.uint8)
    got = chunk_bpe.rolling(data)
    for i in (31, 100, 299):
        assert got[i] == sum(int(chunk_bpe.GEAR[data[i - j]]) << j for j in range(32)) % (1 << 32)


def test_cuts_are_whole_and_local():
    rng = random.Random(2)
    text = "".join(rng.choice("abc dé你\U0001f600\n") for _ in range(5000))
    raw = text.encode()
    ends = chunk_bpe.cuts(raw, 64)
    assert ends[-1] == len(raw) and ends == sorted(set(ends))
    assert "".join(raw[a:b].decode() for a, b in zip([0, *ends], ends)) == text
    assert max(np.diff([0, *ends])) <= 16 * 64 + 4
    moved = {e + 3 for e in ends} & set(chunk_bpe.cuts(b"xyz" + raw, 64))
    assert len(moved) > 0.9 * len(ends)
    assert chunk_bpe.cuts(b"") == [] and chunk_bpe.cuts(b"a") == [1]
    assert chunk_bpe.cuts(b"a" * 3000)[-1] == 3000


def test_repaired_joins_equal_the_library(library, coder):
    rng = random.Random(8)
    bits = ["word", " ", "  ", "\n", "'", "'re", "'s", ",", ".", "12", "é", "你", "<|endoftext|>", "<|end", "of", "text|>", " a", " the", "\t", "!!!"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        if rng.random() < 0.1:
            text = "x" * rng.randint(1, 30)  # no place to cut at all
        raw = text.encode()
        at = sorted({len(text[:i].encode()) for i in (rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))} - {0, len(raw)})
        spans = list(zip([0, *at], [*at, len(raw)]))
        pieces = [chunk_bpe.Piece(coder, a, b, coder.encode([raw[a:b].decode()])[0]) for a, b in spans]
        assert chunk_bpe.joined(coder, raw, pieces).tolist() == library.encode(text, add_special_tokens=False).ids, (text, spans)


def test_shared_passages(spark, library):
    rng = random.Random(4)
    passage = words(rng, 200)
    texts = [words(rng, rng.randint(0, 60)) + rng.choice(["", " ", "\n"]) + passage + rng.choice(["", "s", " "]) + words(rng, 30) for _ in range(30)]
    texts += texts[:3] + [words(rng, 50) for _ in range(20)] + [passage * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in chunk_bpe.encode_documents(df, PATH, 64).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == texts[r["doc_id"]]
    chunks = chunk_bpe.chunk_table(df, 64)
    assert chunks.groupBy("digest").count().where("count > 25").count() > 5


def test_report_awkward(spark, library):
    got = chunk_bpe.coding_report(clashing(awkward(spark), "key", "shared", "ids"), PATH, 64).collect()
    want = []
    for doc, text, *_ in awkward_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert chunk_bpe.coding_report(empty(spark), PATH).count() == 0


def test_report_on_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = chunk_bpe.coding_report(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_texts_of_equal_hashes_decode_to_themselves(spark, library):
    """The Thue-Morse word and its complement, which polynomial hashes modulo 2^64 can't tell apart."""
    letters = [bin(i).count("1") % 2 for i in range(8192)]
    texts = [f"w {''.join(s[k] for k in letters[:n])} w" for n in (1024, 2048, 4096, 8192) for s in ("ab", "ba")] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in chunk_bpe.encode_documents(df, PATH).collect():
        assert r["decoded"] == texts[r["doc_id"]]
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
