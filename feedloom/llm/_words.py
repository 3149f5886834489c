"""Vectorised words of UTF-8 texts: spans and 64-bit hashes in numpy, no loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The odd base of the polynomial hash and the mixing constants of splitmix64.
BASE = 0x9E3779B97F4A7C15 | 1
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 21


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        x = np.full(BLOCK + 1, np.uint64(base))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space (0x20, 0x09 to 0x0D)."""
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    return edge[0::2], edge[1::2]


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of at most BLOCK bytes of ``data``: equal bytes have equal hashes, wherever they stand."""
    if len(data) <= BLOCK:
        return _hash_block(data, starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        out[i:j] = _hash_block(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers()
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of ``data``, case kept; equal words have equal hashes.

    Works in blocks of about 2 MB cut between words, so memory stays bounded but for the result. A single word longer
    than a block is hashed by pieces, combined in order.
    """
    starts, ends = spans(data)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, side="right"))
        if j <= i:
            total = np.uint64(0)
            for at in range(base, ends[i], BLOCK):
                piece = data[at : min(at + BLOCK, ends[i])]
                total = mix(np.array([total], np.uint64) + _hash_block(piece, np.array([0]), np.array([len(piece)])))[0]
            out[i], i = total, i + 1
            continue
        out[i:j] = _hash_block(data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base)
        i = j
    return out, starts, ends


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, order included; a shorter, non-empty text is one run."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(BASE) + hashes[j : j + n]
    return mix(total + np.uint64(width))
