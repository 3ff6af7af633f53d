"""Vectorised features of whole texts: hashed words, hashed byte n-grams, character and line statistics.

Everything works on the UTF-8 bytes of a text in blocks of ``BLOCK``, so that memory is bounded for
any length; a block ends at white space where it has any, and a word without any is carried over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that its powers can be divided by modulo 2**64
MIX = np.uint64(0xD6E8FEB86659FD93)
IN_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def upto(base: int) -> np.ndarray:
        p = np.full(BLOCK + 1, base, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return upto(BASE), upto(pow(BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def blocks(raw: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while len(raw) - at > BLOCK:
        spaces = np.flatnonzero(SPACES[raw[at : at + BLOCK]])
        end = at + (int(spaces[-1]) + 1 if len(spaces) else BLOCK)
        yield raw[at:end]
        at = end
    yield raw[at:]


def _sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials in ``BASE`` of the byte strings ``raw[start:end]``."""
    power, inverse = _powers()
    summed = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=summed[1:])
    return (summed[ends] - summed[starts]) * inverse[starts]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``raw[start:end]``; equal strings have equal hashes wherever they lie."""
    return mix(_sums(raw, starts, ends))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, inside: np.ndarray = IN_WORD) -> np.ndarray:
    """Hashes of the words of a text, in order; a word is a run of bytes that ``inside`` marks.

    A word that goes over the end of a block is carried on: its sum and length so far."""
    found = [np.empty(0, np.uint64)]
    carried = np.empty(0, np.uint64)  # one sum, or none
    length = 0
    for block in blocks(raw):
        if not len(block):
            continue
        starts, ends = spans(inside[block])
        sums = _sums(block, starts, ends)
        if len(carried) and len(starts) and starts[0] == 0:
            sums[:1] = carried + sums[:1] * np.uint64(pow(BASE, length, 1 << 64))
        else:
            found.append(carried)
            length = 0
        if len(ends) and ends[-1] == len(block):
            length = int(ends[-1] - starts[-1]) + (length if starts[-1] == 0 else 0)
            carried, sums = sums[-1:], sums[:-1]
        else:
            carried, length = sums[:0], 0
        found.append(sums)
    return mix(np.concatenate([*found, carried]))


def ngram_counts(raw: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the byte n-grams of the given orders, hashed to ``2**bits`` places."""
    counts = np.zeros(1 << bits, np.int64)
    longest = max(orders)
    for at in range(0, max(len(raw), 1), BLOCK):
        block = raw[at : at + BLOCK + longest - 1].astype(np.uint32)
        own = min(BLOCK, len(raw) - at)
        for n in orders:
            k = min(own, len(block) - n + 1)
            if k > 0:
                h = np.full(k, n, np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x01000193) + block[j : j + k]
                h *= np.uint32(0x9E3779B1)
                counts += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return counts
