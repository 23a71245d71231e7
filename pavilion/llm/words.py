"""Words of many texts at once, as 64-bit hashes, straight from an Arrow string column."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Longer words, which are rare, are hashed one by one.
LONG_WORD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * MIX1
    x ^= x >> U(33)
    x *= MIX2
    x ^= x >> U(33)
    return x


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column.

    ``first``: for text i, its words are first[i]:first[i + 1]; ``start`` and ``end``: their bytes in ``data``; ``hashes``: 64 bits a word.
    ``lower`` folds A-Z before hashing.
    """

    def __init__(self, texts: pa.StringArray, lower: bool = False) -> None:
        data, offsets = text_bytes(texts)
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        if len(data):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            begins = offsets[:-1]
            before[begins[begins < len(data)]] = False
            ends = offsets[1:]
            after[ends[ends > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = self._hash(_LOWER[data] if lower else data)

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[:len(data)] = data
        lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = self.end - self.start
        hashes = mix((lanes[self.start] & _LANE[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * GOLD))
        more, done = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
        while len(more):
            left = length[more] - done
            lane = lanes[self.start[more] + done] & _LANE[np.minimum(left, 8)]
            hashes[more] = mix(hashes[more] * GOLD + mix(lane + GOLD))
            done += 8
            more = more[left > 8]
        for i in np.flatnonzero(length > LONG_WORD):
            hashes[i] = int.from_bytes(hashlib.blake2b(data[self.start[i]:self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return hashes


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` hashes (empty if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for j in range(n):
        out *= MIX1
        out += hashes[j:j + count]
        out ^= out >> U(29)
    return mix(out)
