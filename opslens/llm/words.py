"""Words of many texts at once, as 64-bit hashes, in numpy.

A batch's texts are taken as one run of UTF-8 bytes. A word's hash is the sum
of mixed (byte, place) values, mixed again; two words of one corpus share a hash
with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def byte_classes(blanks: str, breaks: str = "") -> np.ndarray:
    """byte -> 0 inside a word, 1 blank, 2 end of a piece."""
    table = np.zeros(256, np.uint8)
    table[[ord(c) for c in blanks]] = 1
    table[[ord(c) for c in breaks]] = 2
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, A-Z lowered, and the offset of each text
    (nulls are empty); one more offset at the end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return _LOWER[raw], at - at[0]


def runs(offsets: np.ndarray, most: int = 8_000_000) -> list[tuple[int, int]]:
    """Runs of texts (lo, hi) of about ``most`` bytes together, or one text."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


class Words:
    """Words of a run of texts: hash, text number, first byte, end byte; and
    ``piece``, a number that changes wherever a piece or a text ends."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
        self.raw = raw
        kind = classes[raw]
        # a text's first byte begins a word of its own whatever stands before it
        first = np.zeros(len(raw) + 1, bool)
        first[offsets[:-1]] = True
        inside = kind == 0
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.zeros(len(raw), bool)
        after[:-1] = inside[1:] & ~first[1:-1]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        size = self.end - self.start
        if len(size):
            place = np.flatnonzero(inside)
            word = np.repeat(np.arange(len(size), dtype=np.int32), size)
            with np.errstate(over="ignore"):
                x = (place - self.start[word]).astype(np.uint64)
                x <<= np.uint64(8)
                x |= raw[place]
                x *= _M1
                x ^= x >> np.uint64(32)
                x *= _M2
                x ^= x >> np.uint64(29)
                self.hash = mix(np.add.reduceat(x, np.cumsum(size) - size) + size.astype(np.uint64))
            ends = np.cumsum(kind == 2)
            self.piece = ends[self.start] + self.doc
        else:
            self.hash, self.piece = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> str:
        return self.raw[self.start[i]:self.end[i]].tobytes().decode("utf-8", "surrogatepass")
