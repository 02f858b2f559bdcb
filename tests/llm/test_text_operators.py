import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
import zstandard

from dinefold.llm import language_id, pii, queries, tree_dedup, vp_simhash
from dinefold.llm.components import connected_components
from tests.compare import compare, duck
from tests.llm.helpers import awkward, awkward_rows, clashing, empty, words

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# exact dedup


@pytest.mark.parametrize("keep,fanout", [("min", 2), ("max", 2), ("max", 16)])
def test_tree_dedup(spark, keep, fanout):
    df = clashing(awkward(spark).repartition(7), "_run", "kept", "_digest")
    got = tree_dedup.tree_dedup(df, keep=keep, fanout=fanout).collect()
    groups = {}
    for doc, text, *_ in awkward_rows():
        groups.setdefault(lowered(text), []).append(doc)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        want += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: (r[3], r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert tree_dedup.tree_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.llm_oracles()))
def test_oracle(spark, name):
    assert compare(queries.llm_queries()[name](spark, SF), duck(SF), queries.llm_oracles()[name]) == []


# language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.predictions(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert len(got) == len(truth) and 200 < len(held) < 300
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # Under one per cent of the documents, which are all in one language, go.
    assert sum(r["rejected"] for r in got.values()) < 10


def test_language_against_plain_compression(spark):
    """Sizes of whole texts by fresh compressors; texts of two languages are mostly rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries, floors = language_id.learned(docs)
    assert list(dictionaries)[0] == "en" and floors[0] == 0 and sum(f > 0 for f in floors) >= 1

    def plain(text):
        raw, sizes = text.lower().encode(), {}
        for lang, content in dictionaries.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = dict(level=language_id.LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)
            blocks = (raw[i : i + language_id.BLOCK] for i in range(0, len(raw), language_id.BLOCK))
            sizes[lang] = sum(len(zstandard.ZstdCompressor(**options).compress(b)) for b in blocks)
        first, second = sorted(sizes.values())[:2]
        return min(sizes, key=sizes.get), 1 - first / second

    rows = docs.where("doc_id % 25 = 3").select("doc_id", "text", "lang")
    for r in language_id.identify(rows, dictionaries, floors).where("lang_pred <> 'und'").collect():
        lang, margin = plain(r["text"])
        assert abs(r["score"] - margin) < 0.05 and (r["lang_pred"] == lang or margin < 0.05)

    by_lang = {}
    for r in docs.where(language_id.held_out()).where("length(text) > 600").orderBy("doc_id").collect():
        by_lang.setdefault(r["lang"], []).append(r["text"][:500])
    langs = sorted(k for k in by_lang if k)
    mixed = [(a + " " + b,) for i, x in enumerate(langs) for y in langs[i + 1 :] for a, b in zip(by_lang[x][:15], by_lang[y][:15], strict=False)]
    found = language_id.identify(spark.createDataFrame(mixed, "text string"), dictionaries, floors)
    assert found.where("rejected").count() >= len(mixed) / 2 > 20


def test_language_awkward(spark):
    df = clashing(awkward(spark), "score", "rejected")
    got = language_id.identify(df, {"en": b" the cat ", "de": b" der hund "})
    assert {"in_score", "in_rejected", "score"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert {r["lang_pred"] for r in language_id.identify(df, {}).collect()} == {"und"}
    assert language_id.train(empty(spark)) == {}
    assert language_id.predictions(empty(spark)).count() == 0


def test_language_narrow_margin_is_rejected():
    own = " ".join(f"{chr(97 + i)}{chr(98 + i)}q" for i in range(24))
    same, floors = (("en", own.encode()), ("de", own.encode())), (0.0, 0.1, 0.1, 0.1)
    assert language_id.classify(own, same, floors) == ("en", 0.0, True)
    assert language_id.classify(own, (("en", own.encode()), ("de", b"zzz")), floors)[2] is False
    # Too short for a margin, and no floors.
    assert language_id.classify("few words", same, floors)[2] is False
    assert language_id.classify(own, same)[2] is False


def test_language_reads_every_labelled_text(spark):
    """A word that no draw of a few texts would hold is counted, and the floors rise with the margins of all other texts."""
    rows = [(i, f"{'the' if i % 2 else 'der'} w{i % 7} " + ("rarest" if i == 1 else "x"), "en" if i % 2 else "de") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn, known = language_id._labelled(df)
    assert drawn.where("_draw <= _upto or _draw > _upto").count() == len(rows) and sorted(known) == ["de", "en"]
    counted = {r["text"] for r in drawn.where("_draw <= _upto").collect()}
    assert drawn.where("_draw <= _upto").count() > 4000
    found = language_id.train(df)
    assert all(f" {w} ".encode() in found["en" if "the" in t else "de"] for t in counted for w in t.split())
    # What does not fit is the less frequent; the most frequent word stands last.
    small = language_id.train(df, 12)
    assert {len(d) <= 13 for d in small.values()} == {True} and small["en"].split()[-1] in (b"the", b"x")


def test_language_learns_from_single_and_blank_texts(spark):
    rows = [(1, "the only english text of the table", "en"), (2, " ", "xx"), (3, None, "yy"), (4, "ein text", "de"), (4, "ein text", "de")]
    found = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"en", "xx", "de"} and b"only english" in found["en"] and b"ein text" in found["de"]


# personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        own = []
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                own.append(m.span())
        out[kind] = own
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a", "Z.", "@", "@", "b-c", ".de", "..", "%", "1", "22", "255", "256", "0", "00001", ".", ".", " ", "-", "+", "+1", "(", ")", "4111111111111111", "5500 0000 0000 0004", "é", "\n", "x@y.z"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    text = "a" * 300_000 + "1" * 300_000 + "@" * 1000
    assert pii.base_spans(text) == {k: [] for k in pii.KINDS}


def test_disclosing_terms(spark):
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 20)}\nwrite to zorblax alias q{i}x at agent@hq.org today {words(rng, 20)}", "en", "s", 1) for i in range(6)]
    rows += [(100 + i, f"{words(rng, 30)} today write at noon to all", "en", "s", 1) for i in range(200)]
    rows += [(400 + i, rows[0][1], "en", "s", 1) for i in range(30)]  # copies of one text are one witness
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["term"]: r for r in pii.disclosing_terms(df).collect()}
    assert "zorblax" in found and "alias" in found
    assert not {"today", "write", "at", "q0x", "org"} & set(found)
    assert found["zorblax"]["share"] == 1.0
    assert found["zorblax"]["bits"] == pytest.approx(np.log2(206 / 6))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert "agent@hq.org" not in clean[0] and "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and "[TERM]" in clean[0]
    assert all(clean[d] == t for d, t, *_ in rows if 100 <= d < 400)
    report = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert report[0]["n_email"] == 1 and "hint:" in report[0]["spans"] and report[100]["spans"] == ""


def test_report_awkward(spark):
    got = pii.report(clashing(awkward(spark), "_hint", "key", "term")).collect()
    want = []
    for doc, text, *_ in awkward_rows():
        base = plain_spans(text or "")
        want.append((doc, *(len(base[k]) for k in pii.KINDS), hashlib.sha256(pii.listed(base).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    clean = pii.sanitised(clashing(awkward(spark), "_hint", "_key")).collect()
    assert len(clean) == len(awkward_rows()) and any(r["text"] is None for r in clean)
    assert not any("a.b@c.de" in (r["text"] or "") for r in clean)
    assert pii.report(empty(spark)).count() == 0


# near duplicates


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps):
    """Smallest index reachable by links of 3 bits at most, by brute force over all pairs."""
    fps = np.array(fps, dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_near_duplicates_awkward(spark):
    rows = awkward_rows()
    got = vp_simhash.near_duplicates(clashing(awkward(spark), "fp", "root", "component_id")).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = plain_classes(fps)
    ids = {c: min((rows[i][0] for i in np.flatnonzero(label == c) if rows[i][0] is not None), default=None) for c in set(label.tolist())}
    want = [(rows[i][0], f"{fps[i]:016x}", ids[label[i]]) for i in range(len(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert vp_simhash.near_duplicates(empty(spark)).count() == 0


def crowded(rng, n):
    """Fingerprints with clusters whose members differ in a few bits."""
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            out.append(centre)
            for _ in range(rng.randint(1, 4)):
                centre ^= 1 << rng.randrange(64)
    return out[:n]


def test_tree_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(vp_simhash, "LEAF", 50)
    monkeypatch.setattr(vp_simhash, "grow", lambda p, r, radius: _grow(p, r, radius, 50))
    fps = sorted(set(crowded(random.Random(4), 3000)))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = vp_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert edges.count() < 2 * len(fps)
    root = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    label = plain_classes(fps)
    mine = {}
    for f, c in zip(signed, label.tolist()):
        mine.setdefault(root.get(f, f), set()).add(c)
    assert all(len(c) == 1 for c in mine.values()) and len(mine) == len(set(label.tolist()))


_grow = vp_simhash.grow


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 500), (None, 3), (700, 600)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 700: 600}
    assert connected_components(edges.limit(0)).count() == 0
