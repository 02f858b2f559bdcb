"""Language identification by compression with per-language dictionaries.

Each language gets a raw-content zstandard dictionary of its most frequent words, counted over all its training
texts but a quarter, which learns the floors. A whole text, lower-cased, is compressed with every dictionary; the
language with the smallest output wins. A margin between the two smallest outputs that is narrower than nearly all
margins of labelled texts of its length class rejects the text: it stands between two languages. These floors are
learned from all labelled texts whose words are not in the dictionaries. A class with too few of them, and texts too
short for a margin to mean anything, have no floor. Every labelled text is read for the one or for the other.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow
from dinefold.session import stored

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
NEW_COLUMNS = ("lang_pred", "score", "rejected")

#: Languages that are learned, the most frequent ones; bytes of a dictionary; characters of a word, longer ones are cut.
LANGUAGES = 256
DICT_BYTES = 256 << 10
WORD = 32
#: The share of a language's texts whose words are counted; the others learn the floors.
COUNTED = 0.75
#: Counts from here on are one in the table by which a dictionary is filled.
MANY = 1 << 16
LEVEL = 7
#: A text is compressed in blocks of this many bytes: memory doesn't grow with it, and the dictionary
#: counts for more than the text's own beginning.
BLOCK = 4 << 10
#: Length classes begin at these numbers of bytes; shorter texts are never rejected for their margin.
CLASSES = (64, 512, 4096)
#: The fewest texts of a class that give a floor, and the share of correctly labelled texts that a floor may reject.
FLOOR_FEWEST = 100
FLOOR_SHARE = 0.005


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _labelled(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with a label and a text, each with a draw of 30 bits and the draw up to which its language's words are
    counted (null beyond the most frequent languages); and those languages, the most frequent first.

    Repeated rows are drawn together. A language has at least the text with its smallest draw counted.
    """
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_draw", draw)
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_draw").alias("least")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    upto = [F.lit(x) for r in known for x in (r["lang"], max(int(COUNTED * (1 << 30)), r["least"]))]
    upto = F.try_element_at(F.create_map(*upto), F.col("lang")) if upto else F.lit(None).cast("long")
    return rows.withColumn("_upto", upto), [r["lang"] for r in known]


def train(labelled: DataFrame, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, the language with most rows first, from rows (doc_id, text, lang).

    The words of all counted texts are counted by Spark; a dictionary has the most frequent ones, as many as fit, the
    most frequent last, equally frequent ones in the order in which texts have them. The driver gets the sizes of the
    words of equal count and what fits. No rows: no dictionaries.
    """
    rows, known = _labelled(labelled)
    if not known:
        return {}
    counted = rows.where("_draw <= _upto").select("lang", "_draw", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\S{{1,{WORD}}}"), F.lit(0))).alias("place", "word"))
    # The draw of a text and a word's place in it as one number, so that the aggregate stays a plain one.
    at = F.min(F.shiftleft("_draw", 30) + F.least("place", F.lit((1 << 30) - 1))).alias("at")
    words = stored(counted.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"), at), "language-words")
    size = F.octet_length("word") + 1
    level = F.least("n", F.lit(MANY))
    left = dict.fromkeys(known, dict_bytes - 1)
    # By language, the least count of which all words fit, and of the next lower one the draws up to which they do.
    least, part = dict.fromkeys(known, 1), dict.fromkeys(known, (0, 0))
    full = set()
    for r in words.groupBy("lang", level.alias("n")).agg(F.sum(size).alias("bytes")).orderBy("lang", F.desc("n")).toLocalIterator():
        lang, n = r["lang"], r["n"]
        if lang not in full:
            if r["bytes"] > left[lang]:
                full.add(lang)
                least[lang], part[lang] = n + 1, (n, int((1 << 60) * left[lang] / r["bytes"]))
            left[lang] -= r["bytes"]
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))
    some = (level == of({k: v[0] for k, v in part.items()})) & (F.col("at") <= of({k: v[1] for k, v in part.items()}))
    fits = words.where((level >= of(least)) | some)
    found: dict[str, list[tuple[int, int, str]]] = {lang: [] for lang in known}
    for r in fits.toLocalIterator():
        found[r["lang"]].append((-r["n"], r["at"], r["word"]))
    out = {}
    for lang in known:
        kept, room = [], dict_bytes - 1
        for n, place, word in sorted(found[lang]):
            room -= len(word.encode()) + 1
            if room < 0:
                break
            kept.append((-n, place, word))
        out[lang] = f" {' '.join(w for *_, w in sorted(kept))} ".encode()
    return out


def length_class(n_bytes: Column) -> Column:
    return sum((F.when(n_bytes >= least, 1).otherwise(0) for least in CLASSES), F.lit(0))


def margin_floors(labelled: DataFrame, dictionaries: dict[str, bytes]) -> tuple[float, ...]:
    """The least margin of each length class, from all labelled rows (doc_id, text, lang) that the dictionaries don't count."""
    floors = [0.0] * (len(CLASSES) + 1)
    if len(dictionaries) < 2:
        return tuple(floors)
    rows, _ = _labelled(labelled)
    others = rows.where("_draw > _upto")
    labels = identify(others.select("text", "lang"), dictionaries).where("lang_pred = lang")
    size = length_class(F.octet_length(F.lower("text")))
    by_class = labels.groupBy(size.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", FLOOR_SHARE, 100_000).alias("floor"))
    for r in by_class.where(f"c > 0 and n >= {FLOOR_FEWEST}").collect():
        floors[r["c"]] = r["floor"]
    return tuple(floors)


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> dict:
    out = {}
    for lang, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], floors: tuple[float, ...] = ()) -> tuple[str, float, bool]:
    """(language, relative margin, rejected). Ties go to the language that comes first."""
    if not dictionaries or not LETTER.search(text or ""):
        return UNKNOWN, 0.0, True
    raw = text.lower().encode()
    sizes = {lang: sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for lang, c in _compressors(dictionaries).items()}
    best = min(sizes, key=sizes.get)
    others = [n for lang, n in sizes.items() if lang != best]
    margin = 1 - sizes[best] / min(others) if others else 1.0
    floor = floors[sum(len(raw) >= least for least in CLASSES)] if floors else 0.0
    return best, margin, margin < floor


def identify(df: DataFrame, dictionaries: dict[str, bytes], floors: tuple[float, ...] = ()) -> DataFrame:
    """df with lang_pred, score (relative margin, 0 to 1) and rejected; all columns of df stay.

    Null texts and texts without a letter get `und`, score 0, and are rejected, as is everything when
    no language was learned. Without floors nothing else is rejected. Every row is judged by its own text, repeated
    rows alike; an empty table gives no rows; a very long text is compressed in blocks. Columns of df with
    the new names are kept with a leading `in_`.
    """
    pairs = tuple(dictionaries.items())
    df = df.withColumnsRenamed({c: f"in_{c}" for c in NEW_COLUMNS if c in df.columns})

    def label(batch: pa.RecordBatch) -> dict:
        found = [classify(t, pairs, floors) for t in batch["text"].to_pylist()]
        new = {name: [f[i] for f in found] for i, name in enumerate(NEW_COLUMNS)}
        return {c: batch[c] for c in batch.schema.names} | new

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return in_arrow(df, label, f"{schema}, lang_pred string, score double, rejected boolean")


def learned(docs: DataFrame) -> tuple[dict[str, bytes], tuple[float, ...]]:
    """Dictionaries and floors from the documents that are not held out."""
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang")
    dictionaries = train(labelled)
    return dictionaries, margin_floors(labelled, dictionaries)


def predictions(docs: DataFrame) -> DataFrame:
    """Label every document, after learning from those that are not held out."""
    return identify(docs.select("doc_id", "text"), *learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
