"""Words and their hashes for a whole Arrow batch of texts at once, with numpy on the UTF-8 bytes.

A word is a maximal run of 0-9, a-z (after lower-casing A-Z) and bytes from 0x80 up, so every character
beyond ASCII is a word character and runs never end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's start, with the end last; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each (one row at least), so that scratch memory stays bounded."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, min(at + rows, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
        yield at, end
        at = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    lower: np.ndarray  # lower-cased bytes
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # each row's first word, with the number of words last

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def starts_of(self, n: int) -> np.ndarray:
        """Words at which a run of n words of one row begins."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.flatnonzero(np.arange(len(self.start)) + n <= last)

    def run_hash(self, starts: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(n):
            h = h * np.uint64(_BASE) + self.hash[starts + k]
        return mixed(h)


def split(raw: np.ndarray, offsets: np.ndarray) -> Words:
    lower = _LOWER[raw]
    inside = _WORD[lower]
    n = len(lower)
    turn = np.empty(n + 1, bool)
    turn[0], turn[n] = (inside[0], inside[-1]) if n else (False, False)
    turn[1:n] = inside[1:] != inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    start = inside & turn[:n]
    start[cuts] |= inside[cuts]  # a word never crosses rows
    end = np.zeros(n + 1, bool)
    end[1:] = inside & turn[1:]
    end[cuts] |= inside[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        h = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return Words(lower, s, e, h, np.searchsorted(s, offsets, side="left"))
