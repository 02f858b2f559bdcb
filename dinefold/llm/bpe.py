"""Exact byte-level BPE of many texts with the tokenizers library.

Byte-level tokenizers cut a text before they merge: always where white space follows something else,
and between an ASCII letter and a full stop or comma. The stretches in between (units) are encoded by
the library once and then found again by a hash in a table of the Python worker, for a whole batch of texts
at a time. A hash only finds an entry; the entry counts if its bytes are the unit's. Joining the units' ids gives
the library's ids of the whole text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: White space outside ASCII, and characters that only some libraries count as white
#: space. A text with one of them is encoded whole.
UNSURE_POINTS = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
UNSURE = re.compile("[" + "".join(map(chr, UNSURE_POINTS)) + "]")
UNSURE_ASCII = tuple(chr(c) for c in UNSURE_POINTS if c < 0x80)

WHITE = np.zeros(256, dtype=bool)
WHITE[[*range(0x09, 0x0E), 0x20]] = True
STOP = np.zeros(256, dtype=bool)
STOP[list(b".,")] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: Units, and bytes of them, that a worker remembers; beyond, it starts anew.
MEMO_UNITS = 2_000_000
MEMO_BYTES = 64 << 20
#: Units that one call of the library gets as one text, and bytes of text that are cut at once.
JOINED = 4000
PART_BYTES = 1 << 20


class UnitTable:
    """Token ids by 128-bit key: open addressing in arrays, looked up and filled for many keys at once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.place = np.full(1 << self.bits, -1, dtype=np.int32)
        self.size, self.tokens = 0, 0
        self.keys = np.empty((1 << 15, 2), dtype=np.uint64)
        self.start = np.empty(1 << 15, dtype=np.int64)
        self.length = np.empty(1 << 15, dtype=np.int32)
        self.pool = np.empty(1 << 17, dtype="<u4")
        self.bytes, self.raw = 0, np.empty(1 << 17, dtype=np.uint8)
        self.raw_start, self.raw_length = np.empty(1 << 15, dtype=np.int64), np.empty(1 << 15, dtype=np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        found = np.full(len(keys), -1, dtype=np.int32)
        open_, slot, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(open_):
            entry = self.place[slot]
            used = entry >= 0
            open_, slot, entry = open_[used], slot[used], entry[used]
            same = (self.keys[entry] == keys[open_]).all(axis=1)
            found[open_[same]] = entry[same]
            open_, slot = open_[~same], (slot[~same] + 1) & mask
        return found

    def _settle(self, entries: np.ndarray) -> None:
        slot, mask = self._slot(self.keys[entries]), (1 << self.bits) - 1
        while len(entries):
            free = np.flatnonzero(self.place[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.place[slot[won]] = entries[won]
            left = np.ones(len(entries), dtype=bool)
            left[won] = False
            entries, slot = entries[left], (slot[left] + 1) & mask

    def differing(self, entries: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the stretches, that make up data, have no entry or one of other bytes."""
        length = ends - starts
        wrong = (entries < 0) | (self.raw_length[entries] != length)
        offset = np.where(wrong, 0, self.raw_start[entries] - starts)
        unlike = self.raw.take(np.repeat(offset, length) + np.arange(len(data)), mode="clip") != data
        return wrong | np.logical_or.reduceat(unlike, starts) if unlike.any() or wrong.any() else wrong

    def add(self, keys: np.ndarray, units: list[bytes], ids: list[np.ndarray]) -> None:
        """New, distinct keys, the bytes they stand for and their token ids."""
        n, more, raw = len(keys), sum(map(len, ids)), b"".join(units)
        while self.size + n > len(self.keys):
            self.keys, self.start, self.length, self.raw_start, self.raw_length = (
                np.concatenate([x, np.empty_like(x)]) for x in (self.keys, self.start, self.length, self.raw_start, self.raw_length)
            )
        while self.tokens + more > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.bytes + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.empty_like(self.raw)])
        new = slice(self.size, self.size + n)
        self.raw_length[new] = list(map(len, units))
        self.raw_start[new] = self.bytes + np.cumsum(self.raw_length[new]) - self.raw_length[new]
        self.raw[self.bytes : self.bytes + len(raw)] = np.frombuffer(raw, np.uint8)
        self.bytes += len(raw)
        self.keys[new] = keys
        self.length[new] = [len(i) for i in ids]
        self.start[new] = self.tokens + np.cumsum(self.length[new]) - self.length[new]
        self.pool[self.tokens : self.tokens + more] = np.concatenate(ids)
        self.size, self.tokens = self.size + n, self.tokens + more
        if self.size * 2 > len(self.place):
            while self.size * 2 > 1 << self.bits:
                self.bits += 1
            self.place = np.full(1 << self.bits, -1, dtype=np.int32)
            self._settle(np.arange(self.size, dtype=np.int32))
        else:
            self._settle(np.arange(new.start, new.stop, dtype=np.int32))

    def joined(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after another, and how many ids there are up to each."""
        length = self.length[entries].astype(np.int64)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[entries] - (ends - length), length) + np.arange(total)], ends


class UnitHash:
    """Two 64-bit polynomial hashes of stretches of a buffer, from running sums.

    They find an entry, no more: texts can be made that agree in both.
    """

    def __init__(self):
        draw = np.random.default_rng(20240501)
        self.letters = draw.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
        self.bases = [int(b) | 1 for b in draw.integers(1 << 40, 1 << 62, 2)]
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.inverse = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def _prepare(self, n: int) -> None:
        if len(self.powers[0]) <= n:
            size = max(n + 1, PART_BYTES + 1)
            for k, base in enumerate(self.bases):
                for out, factor in ((self.powers, base), (self.inverse, pow(base, -1, 1 << 64))):
                    row = np.full(size, factor, dtype=np.uint64)
                    row[0] = 1
                    out[k] = np.multiply.accumulate(row)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._prepare(len(data))
        keys = np.empty((len(starts), 2), dtype=np.uint64)
        for k in range(2):
            run = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(self.letters[k][data] * self.powers[k][: len(data)], out=run[1:])
            h = (run[ends] - run[starts]) * self.inverse[k][starts]
            keys[:, k] = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return keys


class UnitEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {a.content for a in self.tokenizer.get_added_tokens_decoder().values()}
        if any(WHITE[c] or STOP[c] for token in added for c in token.encode()):
            raise ValueError("an added token that could be cut")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Bytes of text that a token stands for.
        self.width = np.zeros(self.size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token.encode()) if token in added else len(token)
        self.table, self.hash = UnitTable(), UnitHash()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, straight from the library."""
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, units: list[str]) -> list[np.ndarray]:
        """whole() of units that are white space and more, as one text: none changes the ids of another."""
        ids = self.whole(["".join(units)])[0]
        ends, wanted = np.cumsum(self.width[ids]), np.cumsum([len(u.encode()) for u in units])
        cuts = np.searchsorted(ends, wanted)
        if cuts[-1] >= len(ends) or (ends[cuts] != wanted).any():
            return self.whole(units)
        return np.split(ids, cuts[:-1] + 1)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        led = [i for i, u in enumerate(units) if WHITE[u[0]] and u.strip()]
        alone = sorted(set(range(len(units))).difference(led))
        ids: list = [None] * len(units)
        for i, own in zip(alone, self.whole([texts[i] for i in alone])):
            ids[i] = own
        for k in range(0, len(led), JOINED):
            for i, own in zip(led[k : k + JOINED], self._together([texts[i] for i in led[k : k + JOINED]])):
                ids[i] = own
        self.table.add(keys, units, ids)

    def _part(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty texts without unsure characters."""
        buffer = b"".join(raw)
        data = np.frombuffer(buffer, dtype=np.uint8)
        first = np.cumsum([0, *map(len, raw[:-1])])
        white = WHITE[data]
        cut = white.copy()
        cut[1:] &= ~white[:-1]
        cut[1:] |= STOP[data[1:]] & LETTER[data[:-1]]
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = self.hash(data, starts, ends)
        entry = self.table.find(keys)
        if len(missing := np.flatnonzero(entry < 0)):
            _, new = np.unique(keys[missing, 0], return_index=True)
            new = missing[new]
            self._learn(keys[new], [buffer[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            entry[missing] = self.table.find(keys[missing])
        wrong = self.table.differing(entry, data, starts, ends)
        ids, upto = self.table.joined(entry)
        last = np.append(np.searchsorted(starts, first)[1:], len(starts)) - 1
        out = np.split(ids, upto[last][:-1])
        # A unit whose hashes are those of another: its text goes to the library as it is.
        for i in np.unique(np.searchsorted(first, starts[wrong], "right") - 1).tolist():
            out[i] = self.whole([raw[i].decode()])[0]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """As whole(), with units from the table."""
        if self.table.size > MEMO_UNITS or self.table.bytes > MEMO_BYTES:
            self.table.clear()
        out: list = [None] * len(texts)
        part, size = [], 0
        for i, text in enumerate([*texts, None]):
            if text is None or size > PART_BYTES:
                if part:
                    for k, ids in zip((k for k, _ in part), self._part([raw for _, raw in part])):
                        out[k] = ids
                part, size = [], 0
            if text == "":
                out[i] = np.empty(0, dtype="<u4")
            elif text is not None:
                if any(c in text for c in UNSURE_ASCII) if text.isascii() else UNSURE.search(text):
                    out[i] = self.whole([text])[0]
                else:
                    raw = text.encode()
                    part.append((i, raw))
                    size += len(raw)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One encoder for each Python worker and vocabulary file."""
    return UnitEncoder(path)


def id_type(path: str) -> str:
    """The packed type of ids: 16 bits where the vocabulary allows it, else 32."""
    return "<u2" if encoder(path).size <= 1 << 16 else "<u4"
