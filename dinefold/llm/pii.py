"""Personal data: fixed patterns, and terms that reveal the protected values by co-occurrence.

Emails, IP addresses, card and phone numbers are found by pattern; each distinct value is a protected
entity. For every term of a text with an entity the corpus tells how much the term gives
away: of all distinct texts with the term, the share that also has the entity, at any distance (disclosure,
P(entity | term)), and how many bits the term adds over the entity's own frequency (pointwise mutual
information). A term seen with an entity in fewer than SUPPORT texts is held against the corpus: were all terms
of its frequency dealt to texts by their length alone, fewer than CHANCE of them may be expected there. Above the thresholds a term is personal data too: from HINT_BITS on it is generalised to
its kind, from REVEAL_BITS on it is removed. Copies of a text count once.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow, key_filter, may_hold, text_key
from dinefold.session import stored

# The patterns of the contract. Possessive repeats and the look-behind only save time.
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "hint": "[TERM]", "reveal": ""}

#: Distinct texts with term and entity that are enough by themselves. With fewer, a term must be unlikely
#: to meet the entity by chance: CHANCE bounds the number of terms as rare as it that the corpus lets expect there.
SUPPORT = 3
CHANCE = 0.05
DISCLOSURE = 0.95
HINT_BITS = 5.0
REVEAL_BITS = 10.0

def _class(kinds: str) -> str:
    """The inside of a character class of all characters whose Unicode category begins with one of kinds."""
    of = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"[{kinds}]+", of))


#: Terms are runs of letters, marks and digits of any script. Where a script has no spaces between words
#: (Chinese, Japanese, Thai, Lao, Burmese, Khmer), every two neighbouring characters of a run are a term.
#: Only Python reads terms, so there is one class.
TERM = re.compile(f"[{_class('LMN')}]+")
UNSPACED = "฀-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
PIECE = re.compile(f"[{UNSPACED}]+|[^{UNSPACED}]+")
ASCII_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
IS_UNSPACED = re.compile(f"[{UNSPACED}]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in EMAIL_LEFT:
            left -= 1
        right = EMAIL_RIGHT.match(text, at + 1) if left < at else None
        if right:
            found.append((left, right.end()))
            done = right.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return found


def _ips(text: str) -> list[Span]:
    """Leftmost matches: of the numbers that dots join, every four in turn; each digit is read once."""
    found = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    found.append((at, end))
                at = end + 1
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    out["ip"] = _ips(text)
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in spans.items() for a, b in sorted(own))


def _units(text: str) -> Iterator[Span]:
    for m in TERM.finditer(text):
        if m[0].isascii() or not IS_UNSPACED.search(m[0]):
            yield m.span()
            continue
        for piece in PIECE.finditer(text, *m.span()):
            a, b = piece.span()
            if IS_UNSPACED.match(piece[0]):
                yield from ((i, i + 2) for i in range(a, b - 1))
            else:
                yield a, b


def terms_in(text: str, base: dict[str, list[Span]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms that touch no base span, in order; the only reading of terms there is."""
    starts, ends = [], []
    for a, b in sorted(s for own in base.values() for s in own):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for a, b in _units(text):
        k = bisect_right(starts, b - 1)
        if b - a > 1 and not (k and ends[k - 1] > a):
            yield text[a:b].lower(), a, b


def own_terms(text: str, base: dict[str, list[Span]]) -> list[str]:
    """The distinct terms of terms_in(); plain texts, where no term spans white space, give those of their distinct words.

    Σ and İ are the letters whose lower case depends on their neighbours or is longer than they are.
    """
    if any(base.values()) or "Σ" in text or "İ" in text or not (text.isascii() or not IS_UNSPACED.search(text)):
        return list(dict.fromkeys(t for t, _, _ in terms_in(text, base)))
    found, rest = set(), []
    for word in {w.strip(ASCII_MARKS) for w in text.lower().split()}:
        if word.isalnum():
            found.add(word)
        else:
            rest.append(word)
    found.update(TERM.findall(" ".join(rest)))
    return [t for t in found if len(t) > 1]


def normal_form(kind: str, value: str) -> str:
    """One form for the ways to write a value: cards and phones by their digits, addresses without leading zeros."""
    if kind == "email":
        return value.lower()
    return ".".join(str(int(p[-4:])) for p in value.split(".")) if kind == "ip" else _digits(value)


def entities_in(text: str, base: dict[str, list[Span]]) -> list[str]:
    return list(dict.fromkeys(f"{kind}:{normal_form(kind, text[a:b])}" for kind, own in base.items() for a, b in own))


def _distinct(df: DataFrame) -> DataFrame:
    """(key, text), one row per distinct text; only texts that may have copies are shuffled."""
    rows = df.select(text_key().alias("key"), "text")
    again = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bitmap = stored(key_filter(again), "pii-copies")
    return may_hold(rows, bitmap, False).unionByName(may_hold(rows, bitmap, True).dropDuplicates(["key"]))


def disclosing_terms(df: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = HINT_BITS) -> DataFrame:
    """(term, entity, share, bits) of all terms of the corpus above the thresholds; counts are over distinct texts."""

    def beside(batch: pa.RecordBatch) -> dict | None:
        out = {"key": [], "entities": [], "terms": []}
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
            base = base_spans(text or "")
            if any(base.values()):
                out["key"].append(key)
                out["entities"].append(entities_in(text, base))
                out["terms"].append(own_terms(text, base))
        return out if out["key"] else None

    def counted(batch: pa.RecordBatch) -> dict:
        found = Counter()
        for text in batch["text"].to_pylist():
            found.update(own_terms(text, base_spans(text)) if text else ())
        return {"term": list(found), "n": list(found.values())}

    keyed = _distinct(df)
    held = stored(in_arrow(keyed, beside, "key binary, entities array<string>, terms array<string>"), "pii-entities")
    # Every text of the corpus counts for a term, whether or not it has an entity; a batch sends a term once.
    of_term = stored(in_arrow(keyed, counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("with_term")), "pii-words")
    texts = df.select(text_key().alias("key")).distinct().count()
    each = held.select("key", F.size("terms").alias("size"), F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"), F.sum("size").alias("size"))
    # No term can add more bits than an entity has, nor reach the share if it is commoner than this.
    entities = stored(entities.where(F.log2(F.lit(float(texts)) / F.col("with_entity")) >= bits), "pii-entity-counts")
    most = entities.agg(F.max("with_entity")).first()[0] or 0
    rare = F.col("with_term") * disclosure <= most + 1e-6
    # The commonest terms, at most 10,000 whatever the corpus, leave before the join by term.
    total = of_term.agg(F.sum("with_term")).first()[0] or 0
    common = of_term.where(~rare & (F.col("with_term") * 10_000 >= total)).select("term")
    words = held.select("key", F.explode("terms").alias("term")).join(F.broadcast(common), "term", "left_anti").join(of_term.where(rare), "term")
    pairs = words.join(each.drop("size").join(entities, "entity"), "key").where(F.col("with_term") * disclosure <= F.col("with_entity") + 1e-6)
    joint = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), *(F.max(c).alias(c) for c in ("with_term", "with_entity", "size")))
    # A row for each frequency below the support: how many terms have it.
    alike = of_term.where(F.col("with_term") * disclosure < support).groupBy("with_term").agg(F.count(F.lit(1)).alias("alike"))
    expected = F.col("alike") * F.pow(F.col("with_term") * F.col("size") / F.lit(float(total or 1)), "both") / F.factorial(F.least("both", F.lit(20)).cast("int"))
    enough = (F.col("both") >= support) | (expected <= CHANCE)
    share = F.col("both") / F.col("with_term")
    gain = F.log2(share * F.lit(float(texts)) / F.col("with_entity"))
    scored = joint.join(F.broadcast(alike), "with_term", "left").where(enough).select("term", "entity", share.alias("share"), gain.alias("bits"))
    return scored.where((F.col("share") >= disclosure) & (F.col("bits") >= bits))


def term_spans(text: str, terms: dict[str, str], base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Where terms (term -> hint or reveal) stand in a text, outside of the base spans."""
    out: dict[str, list[Span]] = {"hint": [], "reveal": []}
    for term, a, b in terms_in(text, base):
        if term in terms:
            out[terms[term]].append((a, b))
    return out


def replaced(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span exchanged for its kind's mark; of spans that overlap, the first gives the mark."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, own in spans.items() for a, b in own):
        if a >= done:
            out += [text[done:a], MARKS[kind]]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _with_terms(df: DataFrame) -> DataFrame:
    """df and `_hint`, `_reveal`: the disclosing terms of each text. One row per distinct text is joined."""
    flagged = disclosing_terms(df).groupBy("term").agg(F.max("bits").alias("bits"))
    flagged = stored(flagged, "pii-terms")
    if flagged.isEmpty():
        none = F.lit(None).cast("array<string>")
        return df.withColumns({"_hint": none, "_reveal": none})

    def terms(batch: pa.RecordBatch) -> dict:
        return {"_key": batch["_key"], "terms": [own_terms(t, base_spans(t)) if t else [] for t in batch["text"].to_pylist()]}

    words = in_arrow(df.select(text_key().alias("_key"), "text"), terms, "_key binary, terms array<string>")
    words = words.select("_key", F.explode("terms").alias("term")).withColumn("key", F.col("term"))
    words = may_hold(words, stored(key_filter(flagged.select(F.col("term").alias("key"))), "pii-term-filter"), True).drop("key")
    strong = F.col("bits") >= REVEAL_BITS
    held = words.join(flagged, "term").groupBy("_key").agg(F.collect_set(F.when(~strong, F.col("term"))).alias("_hint"), F.collect_set(F.when(strong, F.col("term"))).alias("_reveal"))
    return df.withColumn("_key", text_key()).join(stored(held, "pii-texts"), "_key", "left").drop("_key")


def _spans(batch: pa.RecordBatch) -> list[tuple[str, dict, dict]]:
    out = []
    for text, hint, reveal in zip(*(batch[c].to_pylist() for c in ("text", "_hint", "_reveal"))):
        text = text or ""
        base = base_spans(text)
        terms = dict.fromkeys(hint or (), "hint") | dict.fromkeys(reveal or (), "reveal")
        out.append((text, base, term_spans(text, terms, base) if terms else {}))
    return out


def report(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of df.

    Null texts count as empty. Rows without an id and repeated rows are reported like any other. An empty
    table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = _spans(batch)
        counts = {f"n_{k}": [len(base[k]) for _, base, _ in found] for k in KINDS}
        sums = [hashlib.sha256(listed(base).encode()).hexdigest() for _, base, _ in found]
        return {"doc_id": batch["doc_id"], **counts, "base_sha256": sums, "spans": [listed(base | more) for _, base, more in found]}

    return in_arrow(_with_terms(df.select("doc_id", "text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitised(df: DataFrame) -> DataFrame:
    """df with personal data replaced in `text` (null stays null) and `n_chars`, if there, counted anew."""
    columns = df.columns
    # The columns of df travel as one struct, so that none clashes with those added here.
    marked = _with_terms(df.select("text", F.struct("*").alias("_all")))

    def run(batch: pa.RecordBatch) -> dict:
        texts = [replaced(text, base | more) if given is not None else None for (text, base, more), given in zip(_spans(batch), batch["text"].to_pylist())]
        out = {c: batch["_all"].field(c) for c in columns} | {"text": texts}
        if "n_chars" in columns:
            out["n_chars"] = [len(t) if t is not None else n for t, n in zip(texts, out["n_chars"].to_pylist())]
        return out

    return in_arrow(marked, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
