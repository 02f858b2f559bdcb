import math
import random
import re
import unicodedata
from collections import Counter

from dinefold.llm import pii
from tests.llm.helpers import DOCS, words


def corpus(spark, own):
    rng = random.Random(7)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(own)] + [(1000 + i, words(rng, 30), "en", "s", 1) for i in range(500)]
    return spark.createDataFrame(rows, DOCS)


def test_terms_far_from_the_entity_count(spark):
    rng = random.Random(3)
    # Head and signature; in one text of ten the name also stands beside the address.
    texts = [f"Zorblax {words(rng, 80)} agent@hq.org {'zorblax' if i == 0 else ''} {words(rng, 80)} Quuxville" for i in range(10)]
    found = {r["term"]: r for r in pii.disclosing_terms(corpus(spark, texts)).collect()}
    assert found["zorblax"]["share"] == found["quuxville"]["share"] == 1.0
    assert not {"agent", "hq", "org"} & set(found)
    clean = {r["doc_id"]: r["text"].lower() for r in pii.sanitised(corpus(spark, texts)).collect()}
    assert not any("zorblax" in clean[i] or "quuxville" in clean[i] for i in range(10))


def few_words(spark, own):
    """Beside the texts of own, 500 texts over 200 words: a word seen only once is unusual there."""
    rng = random.Random(9)
    known = [words(rng, 1) + str(i) for i in range(200)]
    rows = [(i, t.format(*rng.sample(known, 9)), "en", "s", 1) for i, t in enumerate(own)]
    rows += [(1000 + i, " ".join(rng.sample(known, 40)), "en", "s", 1) for i in range(500)]
    return spark.createDataFrame(rows, DOCS)


def test_rare_entities_are_judged(spark):
    own = ["{} {} zorblax {} agent@hq.org {} {}", "{} quuxville {} +49 30 1234567 {} {}", "{} {} {} +49 (30) 123-4567 {} quuxville"]
    df = few_words(spark, own)
    found = {r["term"]: r for r in pii.disclosing_terms(df).collect()}
    assert set(found) == {"zorblax", "quuxville"}
    assert found["quuxville"]["entity"] == "phone:49301234567"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert not any("zorblax" in t or "quuxville" in t for t in clean.values())


def test_words_seen_once_are_no_evidence_where_they_are_common(spark):
    rng = random.Random(4)
    texts = [f"{words(rng, 40)} agent{i}@hq.org" for i in range(5)]
    assert pii.disclosing_terms(corpus(spark, texts)).count() == 0


def test_terms_of_any_script(spark):
    own = ["{} Зорблакс {} agent@hq.org {}", "{} Ζορμπλας {} +49 30 1234567 {}", "{} ézorblé {} 10.20.30.40 {}", "{} 山田太郎 {} b@hq.org"]
    df = few_words(spark, own)
    found = {r["term"] for r in pii.disclosing_terms(df).collect()}
    assert found == {"зорблакс", "ζορμπλας", "ézorblé", "山田", "田太", "太郎"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert not any(w in t for t in clean.values() for w in ("Зор", "Ζορ", "zorb", "山", "郎"))


def test_term_class_is_letters_marks_and_digits():
    for c in (*range(0x3000), 0x4E2D, 0xAC00, 0x1F600, 0x20000, 0x1D165):
        assert bool(pii.TERM.match(chr(c))) == (unicodedata.category(chr(c))[0] in "LMN")


def test_both_ways_to_the_terms_agree():
    rng = random.Random(6)
    bits = ["a", "É", "Σ", "ς", "İ", "é", "1", " ", "-", "Ж", "א", "_", ".", "\U0001d165"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert set(pii.own_terms(text, {})) == {t for t, _, _ in pii.terms_in(text, {})}, text


def counted(texts, support=pii.SUPPORT, disclosure=pii.DISCLOSURE, bits=pii.HINT_BITS):
    """Terms that give an entity away, from the definition: plain counts over distinct texts."""
    texts = set(texts)
    own = {}
    for t in texts:
        entities = {f"email:{m.lower()}" for m in re.findall(r"\S+@\S+", t)} | {"phone:" + re.sub("[^0-9]", "", m) for m in re.findall(r"\+[0-9]+", t)}
        own[t] = entities, {w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"\S+@\S+|\+[0-9]+", " ", t)) if len(w) > 1}
    seen = Counter(w for _, terms in own.values() for w in terms)
    alike, total = Counter(seen.values()), sum(seen.values())
    out = {}
    for e in {e for entities, _ in own.values() for e in entities}:
        held = [terms for entities, terms in own.values() if e in entities]
        size = sum(map(len, held))
        for term, both in Counter(w for terms in held for w in terms).items():
            share, expected = both / seen[term], alike[seen[term]] * (seen[term] * size / total) ** both / math.factorial(both)
            gain = math.log2(share * len(texts) / len(held))
            if (both >= support or expected <= pii.CHANCE) and share >= disclosure and gain >= bits and math.log2(len(texts) / len(held)) >= bits:
                out[term, e] = (round(share, 9), round(gain, 9))
    return out


def test_disclosing_terms_equal_a_plain_count(spark):
    rng = random.Random(12)
    known = [words(rng, 1) + str(i) for i in range(150)]
    names = [f"name{i}x" for i in range(12)]
    texts = [" ".join(rng.choices(known, k=rng.randint(1, 30))) for _ in range(420)]
    for i in range(60):
        who = rng.randrange(12)
        entity = f"who{who}@hq.org" if who % 2 else f"+4930{who}55512"
        near = names[who] if rng.random() < 0.9 else rng.choice(names)
        texts.append(" ".join([*rng.choices(known, k=8), entity, near, *rng.choices([f"rare{i}", f"few{i // 2}"], k=1), *rng.choices(known, k=rng.randint(0, 60))]))
    texts += [f"{rng.choice(names)} alone {rng.choice(known)}" for _ in range(3)] + texts[400:450] * 3
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {(r["term"], r["entity"]): (round(r["share"], 9), round(r["bits"], 9)) for r in pii.disclosing_terms(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    want = counted(texts)
    assert got == want and len({e for _, e in want}) >= 3


def test_report_and_sanitised_use_the_same_terms(spark):
    """Each hint and reveal span of the report is a flagged term, each flagged term's place is a span."""
    own = ["{} {} Zorblax {} agent@hq.org {} {}", "{} quuxville {} +49 30 1234567 {} {}", "{} {} {} +49 (30) 123-4567 {} quuxville"]
    df = few_words(spark, own)
    terms = {r["term"] for r in pii.disclosing_terms(df).collect()}
    for r in pii.report(df).join(df.select("doc_id", "text"), "doc_id").collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        found = {(int(a), int(b)) for kind, a, b in spans if kind in ("hint", "reveal")}
        assert found == {m.span() for m in re.finditer(r"[^\W_]+", r["text"]) if m[0].lower() in terms}
