import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dinefold.llm import rans_files
from dinefold.llm.bpe import UnitEncoder
from tests.llm.helpers import awkward, awkward_rows, clashing, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_units_equal_the_library(library):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "你", "\U0001f600", "1", "'", "'s", "'re", ".", ",", " ", "  ", "\n", "\t", "\r", " ", " ", "　", "\x1c", "᠎", "​", "<|endoftext|>", "<|endof", "_", "word", "word.", ",word", "\n\n", "é.", "\x0b"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    coder = UnitEncoder(PATH)
    for _ in range(2):
        assert [i.tolist() for i in coder.encode(texts)] == [ids_of(library, t) for t in texts]


def test_memo_is_bounded(monkeypatch, library):
    from dinefold.llm import bpe

    monkeypatch.setattr(bpe, "MEMO_UNITS", 40)
    monkeypatch.setattr(bpe, "PART_BYTES", 100)
    coder = UnitEncoder(PATH)
    for k in range(20):
        texts = [" ".join(f"w{k}x{i}" for i in range(15)), "", "a. b, c"]
        assert [i.tolist() for i in coder.encode(texts)] == [ids_of(library, t) for t in texts]
        assert coder.table.size <= 80


def test_table_grows(library):
    coder = UnitEncoder(PATH)
    texts = [" ".join(f"{k:x}z{i:x}" for i in range(3000)) for k in range(40)]
    assert [i.tolist() for i in coder.encode(texts)] == [ids_of(library, t) for t in texts]
    assert coder.table.size > 100_000


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 40_000, 300_000])
def test_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 49_999).astype("<u4")
    tokens, seen = np.unique(ids, return_counts=True)
    freq = rans_files.shared_frequencies(dict(zip(tokens.tolist(), seen.tolist())), 50_000)
    assert freq.sum() == (1 << rans_files.SCALE_BITS if n else 0)
    block = rans_files.encode_block(ids, freq)
    table = rans_files.lookup_of(freq)
    assert (rans_files.decode_block(block, table) == ids).all()
    for first in (0, n // 3, n // 2, max(0, n - 1)):
        assert (rans_files.decode_block(block, table, first, first + 777) == ids[first : first + 777]).all()
    if n > 1000:
        assert len(block["words"]) < n * 2
        with pytest.raises(ValueError):
            rans_files.decode_block(block | {"words": b"\1" + block["words"][1:]}, table)


def test_rare_tokens_keep_a_frequency():
    freq = rans_files.shared_frequencies({0: 10**12, **{i: 1 for i in range(1, 60_000)}}, 60_000)
    assert freq.min() == 1 and freq.sum() == 1 << rans_files.SCALE_BITS


def test_file_set(spark, library, monkeypatch):
    monkeypatch.setattr(rans_files, "BLOCK_TOKENS", 500)
    got = rans_files.token_file_report(clashing(awkward(spark), "start", "block", "ids"), PATH, end_id=2).collect()
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = {}, 0
    for doc, text, *_ in rows:
        ids = np.array([*ids_of(library, text), 2], dtype="<u4")
        want.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == d) for d in want}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [r[0] for r in rows]
    assert rans_files.token_file_report(empty(spark), PATH).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_units_of_equal_hashes_are_told_apart(library, n):
    """Polynomial hashes modulo 2^64 can't tell these two words, in one batch or in two."""
    pair = [thue_morse(n, "ab"), thue_morse(n, "ba")]
    coder = UnitEncoder(PATH)
    texts = [f"so {pair[0]} it, goes", pair[1], *pair, f"{pair[0]} {pair[1]} and {pair[0]}"]
    for _ in range(2):
        assert [i.tolist() for i in coder.encode(texts)] == [ids_of(library, t) for t in texts]
        for t in texts:
            assert coder.encode([t])[0].tolist() == ids_of(library, t)


def test_files_of_texts_with_equal_hashes(spark, library):
    texts = [f"x {thue_morse(n, s)} y" for n in (1024, 2048, 4096, 8192) for s in ("ab", "ba")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in rans_files.token_file_report(df, PATH, end_id=2).collect():
        ids = [*ids_of(library, texts[r["doc_id"]]), 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_many_texts_of_a_megabyte(spark, library):
    """Batches are bounded by bytes too, and a text beyond the bound is a batch of its own."""
    unit = "some words, and more of them. "
    df = spark.range(24).selectExpr("id as doc_id", f"repeat('{unit}', if(id = 3, 700000, 35000) + cast(id as int)) as text").coalesce(2)
    rows = {r["doc_id"]: r["n_tokens"] for r in rans_files.token_file_report(df, PATH, end_id=2).collect()}
    one, two = len(ids_of(library, unit * 40)), len(ids_of(library, unit * 41))
    assert all(rows[i] - 1 == one + (two - one) * ((700_000 if i == 3 else 35_000) + i - 40) for i in rows) and len(rows) == 24
