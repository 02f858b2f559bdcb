"""BPE encoding that encodes chunks shared by documents once, and decoding.

Texts are cut where a rolling hash of the last bytes hits a pattern, so that equal passages are cut
alike wherever they stand. Chunks that occur more than once are encoded once, in the document that
holds the first of them; the ids go to all other occurrences. What lies between shared chunks is
encoded in place. The merges of a tokenizer don't stop where chunks meet, so each join is repaired: the
text around it, between two places where the tokenizer always cuts (white space after something else),
is encoded again and replaces the ids on both sides. If the ids of a side have no token boundary at that
place, the window grows, in the end to whole chunks, until both sides agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinefold.llm.bpe import UNSURE, UNSURE_ASCII, WHITE, UnitEncoder, encoder, id_type
from dinefold.llm.common import in_arrow, key_filter, may_hold, text_key
from dinefold.session import stored

#: Bytes that the rolling hash sees, and mean bytes of a chunk (a power of two); none has over 16 times as many.
ROLL = 32
MEAN = 1024

GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear[b] << age over the last ROLL bytes, by doubling the span."""
    h = GEAR[data]
    span = 1
    while span < ROLL:
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def cuts(raw: bytes, mean: int = MEAN) -> list[int]:
    """Ends of the chunks of a text, its length included; no character is split."""
    n = len(raw)
    if n <= ROLL:
        return [n] if n else []
    data = np.frombuffer(raw, dtype=np.uint8)
    hit = np.flatnonzero(rolling(data)[ROLL - 1 :] >> np.uint32(32 - mean.bit_length() + 1) == 0) + ROLL
    # A cut inside a character moves on to the next one's start.
    out, last = [], 0
    for at in [*hit.tolist(), n]:
        while at < n and raw[at] & 0xC0 == 0x80:
            at += 1
        while at - last > 16 * mean:
            last += 16 * mean
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if at > last:
            out.append(at)
            last = at
    return out


def chunk_digests(raw: bytes, mean: int = MEAN) -> list[tuple[int, int, bytes]]:
    """(start, end, 128-bit digest) of each chunk."""
    ends = cuts(raw, mean)
    return [(a, b, hashlib.blake2b(raw[a:b], digest_size=16).digest()) for a, b in zip([0, *ends], ends)]


class Piece:
    """A stretch raw[start:end] with its ids, and the byte at which each token starts."""

    def __init__(self, coder: UnitEncoder, start: int, end: int, ids: np.ndarray):
        self.start, self.end, self.ids = start, end, ids
        self.at = start + np.cumsum(coder.width[ids]) - coder.width[ids]


def _places(raw: bytes, start: int, end: int, forward: bool) -> Iterator[int]:
    """Places inside (start, end) where white space follows something else, nearest to the join first."""
    for at in range(start + 1, end) if forward else range(end - 1, start, -1):
        if WHITE[raw[at]] and not WHITE[raw[at - 1]]:
            yield at


def joined(coder: UnitEncoder, raw: bytes, pieces: list[Piece]) -> np.ndarray:
    """Ids of the text that the pieces make up, with repaired joins.

    Needs a text without unsure white space. `low` is the place up to which the ids in `out` are final.
    """
    out: list[np.ndarray] = []
    k, low, token = 0, pieces[0].start, 0
    while k < len(pieces):
        left = pieces[k]
        if k + 1 == len(pieces):
            out.append(left.ids[token:])
            break
        # Back from the join to a place at which the left ids have a token boundary.
        back, stop = low, token
        for at in _places(raw, low, left.end, False):
            i = int(np.searchsorted(left.at, at))
            if i < len(left.at) and left.at[i] == at:
                back, stop = at, i
                break
        out.append(left.ids[token:stop])
        # On from the join, through as many pieces as it takes.
        while True:
            k += 1
            right, found = pieces[k], None
            for at in _places(raw, right.start, right.end, True):
                i = int(np.searchsorted(right.at, at))
                if i < len(right.at) and right.at[i] == at:
                    found = (at, i)
                    break
            if found or k + 1 == len(pieces):
                break
        low, token = found or (right.end, len(right.ids))
        out.append(coder.encode([raw[back:low].decode()])[0])
    return np.concatenate(out)


def chunk_table(df: DataFrame, mean: int = MEAN) -> DataFrame:
    """(key, start, end, digest): the chunks of every distinct text; copies of a text count once."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(k, *c) for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist()) for c in chunk_digests((t or "").encode(), mean)]
        return {name: [r[i] for r in rows] for i, name in enumerate(("key", "start", "end", "digest"))}

    return in_arrow(df.select(text_key().alias("key"), "text"), run, "key binary, start long, end long, digest binary")


def shared_chunks(docs: DataFrame, chunks: DataFrame, groups: DataFrame, tokenizer: str) -> DataFrame:
    """(key, shared): for texts by their key, the spans of chunks that occur elsewhere too, with their ids.

    Each chunk is encoded once, in the text that holds the first of its occurrences. Ids are packed as
    16-bit numbers where the vocabulary allows it.
    """
    owners = groups.groupBy("first.key").agg(F.collect_list(F.struct("digest", "first.start", "first.end")).alias("own"))
    texts = docs.select("key", "text").dropDuplicates(["key"]).join(owners, "key")
    kind = id_type(tokenizer)

    def encode(batch: pa.RecordBatch) -> dict:
        digests, parts = [], []
        for text, own in zip(batch["text"].to_pylist(), batch["own"].to_pylist()):
            raw = text.encode()
            for c in own:
                digests.append(c["digest"])
                parts.append(raw[c["start"] : c["end"]].decode())
        return {"digest": digests, "ids": [i.astype(kind).tobytes() for i in encoder(tokenizer).encode(parts)]}

    ids = stored(in_arrow(texts, encode, "digest binary, ids binary"), "chunk-ids")
    spans = chunks.dropDuplicates(["key", "start"]).join(ids, "digest")
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end", "ids")).alias("shared"))


def pieces_of(coder: UnitEncoder, raw: bytes, shared: list[dict], kind: str) -> list[Piece]:
    """The shared chunks and, encoded here, what lies between them."""
    known = sorted((c["start"], c["end"], np.frombuffer(c["ids"], dtype=kind).astype("<u4")) for c in shared)
    spans, last = [], 0
    for a, b, ids in [*known, (len(raw), len(raw), None)]:
        if a > last:
            spans.append((last, a, None))
        if b > a:
            spans.append((a, b, ids))
        last = b
    own = iter(coder.encode([raw[a:b].decode() for a, b, ids in spans if ids is None]))
    return [Piece(coder, a, b, next(own) if ids is None else ids) for a, b, ids in spans]


def encode_text(coder: UnitEncoder, text: str, shared: list[dict] | None, kind: str) -> np.ndarray:
    if not shared or (any(c in text for c in UNSURE_ASCII) if text.isascii() else UNSURE.search(text)):
        return coder.encode([text])[0]
    raw = text.encode()
    return joined(coder, raw, pieces_of(coder, raw, shared, kind))


def _rows(tokenizer: str, make):
    """A function from batches (doc_id, text, shared) to rows that make() gives for the ids and decoded text."""
    kind = id_type(tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        coder = encoder(tokenizer)
        texts = [t or "" for t in batch["text"].to_pylist()]
        shared = batch["shared"].to_pylist() if "shared" in batch.schema.names else [None] * len(texts)
        ids: list = [None] * len(texts)
        plain = [i for i, s in enumerate(shared) if not s]
        for i, own in zip(plain, coder.encode([texts[i] for i in plain])):
            ids[i] = own
        for i, s in enumerate(shared):
            if s:
                ids[i] = encode_text(coder, texts[i], s, kind)
        lists = [i.tolist() for i in ids]
        rows = [make(i, t) for i, t in zip(lists, coder.tokenizer.decode_batch(lists, skip_special_tokens=False))]
        return {"doc_id": batch["doc_id"]} | {c: [r[c] for r in rows] for c in make([], "")}

    return run


def code(df: DataFrame, tokenizer: str, make, schema: str, mean: int = MEAN) -> DataFrame:
    """doc_id and what make(ids, decoded text) gives for each text of df, one row per row.

    Null counts as empty, which has no ids. Rows without an id and repeated rows are encoded like any
    other. An empty table gives no rows; other columns are not read.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    chunks = stored(chunk_table(df, mean), "chunks")
    # A chunk of a repeated text is shared as well: rows are counted, not texts.
    first = F.min(F.struct("key", "start", "end")).alias("first")
    groups = stored(chunks.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-chunks")
    # Only texts with a shared chunk, and the few that the filter lets pass by chance, are shuffled.
    occurrences = stored(chunks.join(groups.select("digest"), "digest"), "chunk-places")
    bitmap = stored(key_filter(occurrences), "key-filter")
    some = may_hold(docs, bitmap, True)
    shared = stored(shared_chunks(some, occurrences, groups, tokenizer), "shared-ids")
    run = _rows(tokenizer, make)
    mixed = in_arrow(some.join(shared, "key", "left").select("doc_id", "text", "shared"), run, schema)
    return in_arrow(may_hold(docs, bitmap, False), run, schema).unionByName(mixed)


def encode_documents(df: DataFrame, tokenizer: str, mean: int = MEAN) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text and the text that they decode to; see code()."""
    return code(df, tokenizer, lambda ids, text: {"ids": ids, "decoded": text}, "doc_id long, ids array<int>, decoded string", mean)


def coding_report(df: DataFrame, tokenizer: str, mean: int = MEAN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); see code()."""
    names = [str(i) for i in range(encoder(tokenizer).size)]

    def make(ids: list[int], text: str) -> dict:
        listed = ",".join([names[i] for i in ids])
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}

    return code(df, tokenizer, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", mean)
