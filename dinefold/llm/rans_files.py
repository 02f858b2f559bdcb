"""Token ids as files of static range asymmetric numeral systems (rANS).

A token file set is a folder with three tables:

* `table`: (token, freq), the frequencies that all blocks share; they add up to 2**SCALE_BITS.
* `blocks`: one row per block, in files whose rows ascend by document id. A block holds the ids of
  whole documents, about BLOCK_TOKENS of them, and is decoded on its own.
* `shards`: (shard, tokens), how many ids the blocks of each writing task hold.

In a block, symbol i belongs to lane i mod `lanes`; each lane has a state of its own, all lanes share
one stream of 32-bit words. Every CHECK_STEPS steps a checkpoint keeps the stream position and all
states, so that decoders can start there. `crc32` covers words, states and checkpoints.

Static rANS: x -> (x // f) * 2**b + x mod f + c for a symbol of frequency f and cumulated frequency c,
states stay in [2**31, 2**63).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinefold.llm.bpe import encoder, id_type
from dinefold.llm.common import in_arrow, small_batches
from dinefold.session import scratch_dir

SCALE_BITS = 20
BLOCK_TOKENS = 1 << 18
MAX_LANES = 2048
CHECK_STEPS = 32
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BITS = np.uint64(SCALE_BITS)

IDS = "doc_id long, n_tokens long, ids binary"
BLOCKS = """shard int, block int, start long, doc_ids array<long>, doc_tokens array<long>, tokens long, lanes int,
words binary, states binary, marks binary, crc32 long"""


def shared_frequencies(counts: dict[int, int], size: int) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE_BITS; every token that occurs keeps at least 1."""
    freq = np.zeros(size, dtype=np.int64)
    if not counts:
        return freq
    tokens = np.fromiter(counts, dtype=np.int64)
    seen = np.fromiter(counts.values(), dtype=np.float64)
    target = 1 << SCALE_BITS
    if len(tokens) > target:
        raise ValueError("more tokens than frequencies")
    share = np.maximum(1, np.floor(seen / seen.sum() * (target - len(tokens))).astype(np.int64))
    order = np.argsort(-seen, kind="stable")
    left = target - int(share.sum())
    share[order[0]] += max(0, left)
    for i in order:
        if left >= 0:
            break
        cut = min(-left, int(share[i]) - 1)
        share[i] -= cut
        left += cut
    freq[tokens] = share
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray) -> dict:
    """freq: the shared table. Steps run backwards, so that a decoder reads the words forwards."""
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    f_all, c_all = freq.astype(np.uint64)[ids], cum[ids]
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, marks, emitted = [], [], 0
    for s in range(steps - 1, -1, -1):
        f, c = f_all[s * lanes : (s + 1) * lanes], c_all[s * lanes : (s + 1) * lanes]
        own = x[: len(f)]
        full = own >= f << np.uint64(63 - SCALE_BITS)
        if full.any():
            out = own[full]
            words.append(out.astype(np.uint32))  # the low 32 bits
            emitted += len(out)
            own[full] = out >> WORD
        q = own // f
        x[: len(f)] = (q << BITS) + (own - q * f) + c
        if s and s % CHECK_STEPS == 0:
            marks.append((emitted, x.copy()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    kept = b"".join(np.uint64(emitted - at).tobytes() + state.tobytes() for at, state in reversed(marks))
    return {"tokens": n, "lanes": lanes, "words": stream, "states": x.tobytes(), "marks": kept, "crc32": zlib.crc32(kept, zlib.crc32(x.tobytes(), zlib.crc32(stream)))}


def lookup_of(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    return np.repeat(np.arange(len(freq), dtype=np.uint32), freq), freq.astype(np.uint64), cum


def decode_block(block: dict, table: tuple, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids first to stop of a block; decoding starts at the checkpoint before first."""
    if zlib.crc32(block["marks"], zlib.crc32(block["states"], zlib.crc32(block["words"]))) != block["crc32"]:
        raise ValueError("checksum of a token block")
    lookup, freq, cum = table
    n, lanes = block["tokens"], block["lanes"]
    stop = n if stop is None else min(stop, n)
    words = np.frombuffer(block["words"], dtype="<u4")
    x, at, begin = np.frombuffer(block["states"], dtype=np.uint64).copy(), 0, 0
    if mark := first // lanes // CHECK_STEPS:
        kept = np.frombuffer(block["marks"], dtype=np.uint64)[(mark - 1) * (lanes + 1) : mark * (lanes + 1)]
        x, at, begin = kept[1:].copy(), int(kept[0]), mark * CHECK_STEPS
    end = -(-stop // lanes)
    out = np.empty(max(0, end - begin) * lanes, dtype="<u4")
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for s in range(begin, end):
        k = min(lanes, n - s * lanes)
        own = x[:k]
        slot = own & mask
        symbol = lookup[slot]
        own = freq[symbol] * (own >> BITS) + slot - cum[symbol]
        low = np.flatnonzero(own < LOW)
        own[low] = (own[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        x[:k] = own
        out[(s - begin) * lanes : (s - begin) * lanes + k] = symbol
    return out[first - begin * lanes : max(first, stop) - begin * lanes]


def token_ids(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): packed 16-bit ids where the vocabulary allows it, else 32-bit; end id appended."""
    kind = id_type(tokenizer)

    def encode(batch: pa.RecordBatch) -> dict:
        ids = [np.append(i, end_id).astype(kind) for i in encoder(tokenizer).encode([t or "" for t in batch["text"].to_pylist()])]
        return {"doc_id": batch["doc_id"], "n_tokens": [len(i) for i in ids], "ids": [i.tobytes() for i in ids]}

    return in_arrow(df.select("doc_id", "text"), encode, IDS)


def token_counts(ids: DataFrame, kind: str, size: int) -> DataFrame:
    """(token, n) over all rows; at most one row per entry of the vocabulary and task goes to the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype=kind), minlength=size)
        token = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(seen[token])], names=["token", "n"])

    small_batches(ids.sparkSession)
    return ids.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode all texts of df and write the file set below path, document ids ascending.

    Null and empty texts become the end id alone. Rows without a doc_id come first, rows that repeat an
    id stand next to each other. An empty table writes an empty set. Other columns are not read.
    """
    spark = df.sparkSession
    kind, size = id_type(tokenizer), encoder(tokenizer).size
    held = scratch_dir(spark, "token-ids")
    token_ids(df, tokenizer, end_id).write.option("compression", "zstd").parquet(held)
    ids = spark.read.parquet(held)
    # At most one row per entry of the vocabulary comes to the driver.
    counts = {r["token"]: r["n"] for r in token_counts(ids, kind, size).toLocalIterator()}
    freq = shared_frequencies(counts, size)
    rows = [(int(t), int(freq[t])) for t in np.flatnonzero(freq)]
    spark.createDataFrame(rows, "token long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            all_ids = np.concatenate([np.frombuffer(i, dtype=kind) for _, _, i in held])
            row = {"shard": shard, "block": block, "start": start, "doc_ids": [d for d, _, _ in held], "doc_tokens": [k for _, k, _ in held]}
            return pa.RecordBatch.from_pylist([row | encode_block(all_ids, freq)], schema=arrow)

        waiting = 0
        for batch in batches:
            for doc, k, packed in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                held.append((doc, k, packed))
                waiting += k
                if waiting >= BLOCK_TOKENS:
                    yield flush()
                    block, start, held, waiting = block + 1, start + waiting, [], 0
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(BLOCKS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    written = spark.read.parquet(f"{path}/blocks")
    written.groupBy("shard").agg(F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{path}/shards")


def read_token_files(spark, path: str, size: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), decoded from a file set; blocks are decoded in parallel."""
    freq = np.zeros(size, dtype=np.int64)
    for r in spark.read.parquet(f"{path}/table").toLocalIterator():  # at most one row per entry of the vocabulary
        freq[r["token"]] = r["freq"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup_of(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row, table)
                ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
                begins = ends - np.array(row["doc_tokens"], dtype=np.int64)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(sums), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"]), pa.array(row["doc_tokens"], pa.int64()), pa.array(sums, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    small_batches(spark)
    docs = spark.read.parquet(f"{path}/blocks").mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row of two integers for each file of the set.
    before = spark.read.parquet(f"{path}/shards").select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_report(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = scratch_dir(df.sparkSession, "token-files")
    write_token_files(df, path, tokenizer, end_id)
    return read_token_files(df.sparkSession, path, encoder(tokenizer).size)
