"""Quality of documents: ridge scores on random Fourier features of document statistics.

Each text is read once and becomes a short vector of statistics: lengths, shares of kinds of bytes, how
much words and lines repeat. Random Fourier features, cosines of random projections of the standardised
vector, approximate a Gaussian kernel. Every partition of the labelled rows sums its own normal
equations; their sum is all that fitting needs, and its size depends on the number of features only. The sums
are kept by fold, so the ridge weight is chosen by the error on folds left out, which also follows from
the sums. Scores of the folds left out, counted in narrow bins, give an isotonic calibration by pooling adjacent
violators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinefold.llm.common import in_arrow, small_batches
from dinefold.session import stored

#: Random features, folds, ridge weights to choose from (for each labelled row), bins of the calibration.
FEATURES = 256
FOLDS = 4
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
BINS = 4096
#: Width of the kernel in units of the root of the number of statistics.
WIDTH = 1.0
#: Standardised statistics beyond this many deviations count as that many.
FAR = 8.0
THRESHOLD = 0.3


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


#: Kinds of bytes whose share of a text is a statistic.
KINDS = np.stack(
    [
        _kind(bytes(range(0x61, 0x7B))),
        _kind(bytes(range(0x41, 0x5B))),
        _kind(b"0123456789"),
        _kind(b" \t\n\v\f\r"),
        _kind(b".,;:'\"?()-"),
        _kind(b"!"),
        _kind(b"#$%&*"),
        _kind(b"|<>{}[]\\/=+_@^~`"),
        _kind(bytes(range(0x80, 0x100))),
    ]
)
IS_CAPITAL, IS_WHITE, IS_SENTENCE_END = KINDS[1] > 0, KINDS[3] > 0, _kind(b".!?") > 0
STATISTICS = len(KINDS) + 12


def statistics(text: str | None) -> np.ndarray:
    """The vector of a text, all finite; null counts as empty."""
    raw = (text or "").encode()
    out = np.zeros(STATISTICS, np.float32)
    if not raw:
        return out
    n, data = len(raw), np.frombuffer(raw, np.uint8)
    share = np.bincount(data, minlength=256) / n
    seen = share[share > 0]
    words, lines = Counter(raw.split()), raw.split(b"\n")
    gap = np.ones(n + 2, bool)
    gap[1:-1] = IS_WHITE[data]
    first, last = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:]) - 1
    k, lengths = len(first), last - first + 1 if len(first) else np.zeros(1)
    out[: len(KINDS)] = KINDS @ share
    out[len(KINDS) :] = (
        np.log1p(n),
        np.log1p(k),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        len(words) / max(k, 1),
        max(words.values(), default=0) / max(k, 1),
        np.log1p(max(map(len, lines))),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        -(seen * np.log2(seen)).sum(),
        IS_CAPITAL[data[first]].sum() / max(k, 1),
        IS_SENTENCE_END[data[last]].sum() / max(k, 1),
    )
    return out


@dataclass
class Fourier:
    """The random features: standardise, project, take the cosine."""

    mean: np.ndarray
    deviation: np.ndarray
    features: int = FEATURES
    width: float = WIDTH
    seed: int = 11

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A column of ones and one column per feature."""
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / (self.width * np.sqrt(x.shape[1])), (x.shape[1], self.features))
        phase = rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((x - self.mean) / self.deviation, -FAR, FAR)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / self.features) * np.cos(z @ w + phase)])


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    #: Raw scores and calibrated scores at the same places, both rising.
    raw: np.ndarray
    calibrated: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.fourier(x) @ self.weights, self.raw, self.calibrated)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch["stats"]
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), STATISTICS)


def document_statistics(df: DataFrame) -> DataFrame:
    """(doc_id, stats), one row per row of df."""

    def read(batch: pa.RecordBatch) -> dict:
        flat = [statistics(t) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "stats": list(flat)}

    return in_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read, "doc_id long, stats array<float>")


def normal_equations(rows: DataFrame, fourier: Fourier) -> dict[int, np.ndarray]:
    """By fold, the sum of m m' over rows (stats, y, fold), where m holds 1, the features and y.

    Each task adds up its rows and gives one row per fold and line of the matrix; lines are added by Spark. The
    driver gets FOLDS matrices of (features + 2) squared numbers, whatever the input.
    """
    small_batches(rows.sparkSession)
    side = fourier.features + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            m = np.hstack([fourier(_matrix(batch)), batch["y"].to_numpy(zero_copy_only=False).astype(float)[:, None]])
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                own = m[fold == f]
                sums[f] = sums.get(f, 0) + own.T @ own
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * side, pa.int32()), pa.array(range(side), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["fold", "line", "sums"])

    def added(own: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(s) for s in own["sums"].to_pylist()], axis=0)
        return pa.table({"fold": own["fold"][:1], "line": own["line"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "fold int, line int, sums array<double>"
    lines = rows.select("stats", "y", "fold").mapInArrow(partial, schema).groupBy("fold", "line").applyInArrow(added, schema)
    out: dict[int, np.ndarray] = {}
    for r in lines.toLocalIterator():
        out.setdefault(r["fold"], np.zeros((side, side)))[r["line"]] = r["sums"]
    return out


def ridge(total: np.ndarray, weight: float) -> np.ndarray:
    """Weights of 1 and the features; the constant is not shrunk."""
    a, b = total[:-1, :-1].copy(), total[:-1, -1]
    a[np.diag_indices(len(a))] += weight * total[0, 0]
    a[0, 0] = total[0, 0]
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def squared_error(total: np.ndarray, w: np.ndarray) -> float:
    a, b, yy = total[:-1, :-1], total[:-1, -1], total[-1, -1]
    return float(yy - 2 * w @ b + w @ a @ w)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to values by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def calibration(rows: DataFrame, fourier: Fourier, weights: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores in order and their calibrated values, from models that have not seen the row's fold.

    At most BINS rows come to the driver.
    """

    def scored(batch: pa.RecordBatch) -> dict:
        z, fold = fourier(_matrix(batch)), batch["fold"].to_numpy(zero_copy_only=False)
        raw = np.zeros(len(fold))
        for f, w in weights.items():
            raw[fold == f] = z[fold == f] @ w
        return {"bin": np.floor(np.clip((raw + 0.5) / 2, 0, 1 - 1e-9) * BINS).astype(np.int32), "y": batch["y"], "raw": raw}

    bins = in_arrow(rows.select("stats", "y", "fold"), scored, "bin int, y int, raw double").groupBy("bin")
    found = bins.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).orderBy("bin").collect()
    n, y, raw = (np.array([r[c] for r in found], float) for c in ("n", "y", "raw"))
    rising = isotonic(y, n)
    # One point per block, at the mean raw score; one row more of either label keeps scores off 0 and 1.
    edges = np.flatnonzero(np.append(True, np.diff(rising) != 0))
    total = np.add.reduceat(n, edges)
    return np.add.reduceat(raw * n, edges) / total, (np.add.reduceat(y * n, edges) + y @ n / n.sum()) / (total + 1)


def fit(rows: DataFrame) -> Model | float:
    """A model from rows (stats, y), y 0 or 1; with one label alone its share, without rows 0.5."""
    # Folds by the statistics, so that copies of a text share a fold.
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int")), "quality-train")
    of = [c for i in range(STATISTICS) for c in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i]))]
    n, positive, *moments = rows.agg(F.count(F.lit(1)), F.sum("y"), *of).first()
    if not n or positive in (0, n):
        return positive / n if n else 0.5
    deviation = np.array(moments[1::2])
    fourier = Fourier(np.array(moments[0::2]), np.where(deviation > 1e-9, deviation, 1.0))
    by_fold = normal_equations(rows, fourier)
    total = sum(by_fold.values())
    rest = {f: total - own if len(by_fold) > 1 else own for f, own in by_fold.items()}
    best = min(RIDGES, key=lambda r: sum(squared_error(own, ridge(rest[f], r)) for f, own in by_fold.items()))
    raw, calibrated = calibration(rows, fourier, {f: ridge(rest[f], best) for f in by_fold})
    return Model(fourier, ridge(total, best), raw, np.maximum.accumulate(calibrated))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learned from; a row without an id has no label."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def quality_scores(stats: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score), score from 0 to 1, one row per row of stats."""

    def score(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch)
        return {"doc_id": batch["doc_id"], "score": np.clip(model(x), 0, 1) if isinstance(model, Model) else np.full(len(x), float(model))}

    return in_arrow(stats, score, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Learns from the labelled rows that are not held out, all of them. Null texts count as empty and are scored
    like any other; of several labels of an id the larger counts, null labels do not. Rows without an id and
    repeated rows are scored like any other. An empty table gives no rows; other columns are not read.
    """
    stats = stored(document_statistics(docs), "quality-stats")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).cast("int").alias("y"))
    model = fit(stats.where(~held_out()).join(known, "doc_id").select("stats", "y"))
    scored = quality_scores(stats, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
