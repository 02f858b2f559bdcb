"""Small document tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty, blank, long and repeated texts, copies, near copies, clashing ids."""
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(12)]
    long = words(rng, 9000)
    texts = [*base, base[0], base[0].upper(), base[1] + " tail", None, "", " \n\t ", "x", long, long + " end", "Ärger 你好 <|endoftext|> \U0001f600   it's  we'll\n\n 12,5",
             "mail a.b@c.de, 10.0.0.256 or 10.0.0.25; +49 (30) 123-4567 and 4111 1111 1111 1111 end", "@@ a@b a@b@c.d 1.2.3.4.5 +1 12"]
    rows = [(i * 7 % 101, t, ("en", "de", None)[i % 3], "s", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, base[2], None, None, None), (None, None, None, None, None), rows[3], rows[3]]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


def clashing(df, *names):
    """df with further columns under names that operators use."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
