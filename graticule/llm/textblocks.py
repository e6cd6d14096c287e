"""Texts of Arrow batches as numpy byte blocks: words, hashes and runs without a loop per word.

A word is a longest run of bytes other than space and tab to carriage return. Those bytes never
occur inside a longer UTF-8 sequence, so bytes and code points give the same words. Blocks hold
whole texts and about ``limit`` bytes, one long text at the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: True for space and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n modulo 2**64, and the inverses."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POWERS: tuple[np.ndarray, np.ndarray] = _powers(1 << 12)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each byte span; spans lie in order and within ``data``."""
    global _POWERS
    if len(_POWERS[0]) <= len(data):
        _POWERS = _powers(2 * len(data))
    power, inverse = _POWERS
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Block:
    """Consecutive texts: ``data`` has their bytes, text i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        n = len(self.data)
        letter = ~IS_SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        edge[0] = edge[n] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~letter[:-1]
        after[:-1] |= ~letter[1:]
        start = np.flatnonzero(letter & before)
        end = np.flatnonzero(letter & after) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    @cached_property
    def bounds(self) -> np.ndarray:
        """Word ``bounds[i]`` is the first of text i; the last entry is the number of words."""
        return np.searchsorted(self.words[0], self.offsets, side="left")

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, worked out over stretches of bounded length."""
        start, end, _ = self.words
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, side="right")))
            at = start[i]
            out[i:j] = _span_hashes(self.data[at : end[j - 1]], start[i:j] - at, end[i:j] - at)
            i = j
        return out

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums by text of one number per word."""
        total = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = out * _BASE + hashes[j : j + m]
    return mix(out)


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
