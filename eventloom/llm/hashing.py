"""Vectorised hashing of many texts at once, for the operators that run in Arrow batches.

A text's bytes get prefix sums of random byte values times powers of an odd
base, modulo 2**64; the hash of any byte range is a difference of two sums
brought to a common power and mixed. Ranges of equal bytes hash alike wherever
they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random byte values and odd multipliers, from a fixed seed so that every task agrees.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_RNG.integers(2**61, 2**62, dtype=np.uint64)) * 2 + 1
STEPS = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Bytes that part words, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes handled in one go; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 21
    while size < n:
        size *= 2
    return _powers(size)


class Sums:
    """Prefix sums of one block of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.at = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.at[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the byte ranges [start, end)."""
        return mix((self.at[end] - self.at[start]) * self.down[start])


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, past, bytes, offsets); a zero byte follows each text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK_BYTES):
            size += len(texts[j]) + 1
            j += 1
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[i:j]), np.int64, j - i))
        yield i, j, np.frombuffer(b"\0".join(texts[i:j]) + b"\0", np.uint8), np.concatenate(([0], ends))
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a block and the text that it belongs to."""
    inner = ~SPACE[data]
    inner[offsets[1:] - 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inner.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    return Sums(LOWER[data]).ranges(start, end), np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    empty = np.empty(0, U64)
    for first, past, data, offsets in blocks(texts):
        words, owner = word_hashes(data, offsets)
        bounds = np.searchsorted(owner, np.arange(past - first + 1))
        n = max(0, len(words) - size + 1)
        grams = np.zeros(n, U64)
        for k in range(size):
            grams += words[k : k + n] * STEPS[k]
        grams = mix(grams)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield mix((words[a:b] * STEPS[: b - a]).sum(dtype=U64, keepdims=True) + STEPS[size + int(b - a)])
            else:
                yield empty
