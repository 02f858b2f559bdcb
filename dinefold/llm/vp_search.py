"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to shards by a hash; each shard builds a vantage-point tree over its unit vectors,
where Euclidean distance orders like cosine and obeys the triangle inequality. Queries go in blocks to
every shard and are searched together: a node measures all queries that reach it against its vantage
point, and a branch is left out for a query if it lies further off than `factor` times the distance of
the k-th best so far. Factor 1 is exact; smaller factors prune more. The shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinefold.llm.common import small_batches
from dinefold.session import stored

SHARD_VECTORS = 8192
QUERY_BLOCK = 2048
LEAF = 128
FACTOR = 0.9
#: Distances closer than this are treated as equal; the exact score decides.
SAME = 1e-7


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, n): vectors without nulls or non-finite components and with a length above zero.

    Vectors of different dimensions never meet. Rows without an id take no part.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("n", F.size("v"))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with others, each row summed in the same order, whatever its neighbours.

    Vectors are first scaled by a power of two, which rounds nothing and keeps squares from overflowing.
    """
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Tree:
    """Nodes are (vantage row, bound, inside, outside); leaves are arrays of rows."""

    def __init__(self, unit: np.ndarray, seed: int = 5):
        self.unit, self.draw = unit, np.random.default_rng(seed)
        self.root = self._node(np.arange(len(unit)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        best = None
        for vantage in self.draw.choice(rows, 4, replace=False):
            far = _distances(self.unit[rows], self.unit[vantage][None, :])[:, 0]
            if best is None or far.std() > best[0]:
                best = (far.std(), vantage, far)
        _, vantage, far = best
        bound = float(np.median(far))
        inside = far <= bound
        if inside.all():  # many rows at one distance
            bound = float(far[far < bound].max(initial=-1.0))
            inside = far <= bound
        if not inside.any():
            return rows
        return (vantage, bound, self._node(rows[inside]), self._node(rows[~inside]))

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query, rows that hold its k nearest, itself (own: its id) left out, and all that tie with the last."""
        count = len(queries)
        near = np.full((count, k), np.inf)
        found: list[list[np.ndarray]] = [[] for _ in range(count)]

        def leaf(rows: np.ndarray, who: np.ndarray) -> None:
            far = _distances(queries[who], self.unit[rows])
            far[own[who][:, None] == ids[rows][None, :]] = np.inf
            near[who] = np.sort(np.concatenate([near[who], far], axis=1), axis=1)[:, :k]
            take = far <= near[who, -1][:, None] + SAME
            take &= np.isfinite(far)
            for i, q in enumerate(who.tolist()):
                if take[i].any():
                    found[q].append(np.stack([rows[take[i]], far[i, take[i]]]))

        def go(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                leaf(node, who)
                return
            vantage, bound, inside, outside = node
            far = _distances(queries[who], self.unit[vantage][None, :])[:, 0]
            near_side = far <= bound
            go(inside, who[near_side])
            go(outside, who[~near_side])
            # The other side, for queries that a neighbour there could still serve.
            reach = np.abs(far - bound) <= factor * near[who, -1] + SAME
            go(outside, who[near_side & reach])
            go(inside, who[~near_side & reach])

        go(self.root, np.arange(count))
        out = []
        for q in range(count):
            if not found[q]:
                out.append(np.empty(0, dtype=np.int64))
                continue
            rows, far = np.concatenate(found[q], axis=1)
            out.append(np.unique(rows[far <= near[q, -1] + SAME].astype(np.int64)))
        return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query by cosine, ties to the smaller id.

    Both tables are (vec_id, v, n) as usable() gives them. A query never finds its own id. Rows that repeat
    an id are candidates of their own.
    """
    spark = small_batches(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_vectors))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    # Each shard meets each block of queries once.
    left = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "n", "vec_id", "v", block)
    right = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "n", F.col("vec_id").alias("query_id"), F.col("v"), shard)

    def matrix(part: pa.Table) -> np.ndarray:
        column = part["v"].combine_chunks()
        return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)

    def search(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x, q, ids, own = matrix(rows), matrix(asked), rows["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        tree = Tree(_unit(x))
        out: list[tuple] = []
        for i, hits in enumerate(tree.search(_unit(q), own, ids, k, factor)):
            score = cosines(q[i], x[hits])
            order = np.lexsort([ids[hits], -score])[:k]
            out += [(own[i], ids[hits[j]], score[j]) for j in order]
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=names)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    group = ("shard", "block", "n")
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_report(df: DataFrame, factor: float = FACTOR) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50."""
    vectors = stored(usable(df, "vec_id", "embedding"), "vectors")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), factor=factor)
