"""Distinct word shingles of whole texts as 64-bit hashes, computed over blocks of documents laid end to end."""

from __future__ import annotations

from functools import cache

import numpy as np

from docveil.llm.common import mix

WORDS = 5
BLOCK = 1 << 19
BASE = 0x9E3779B97F4A7C15  # odd, so powers of it have inverses modulo 2**64
_PLACES = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD]


@cache
def _lower() -> np.ndarray:
    """A-Z in lower case; the separators (space and 9 to 13) as 0."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of documents, and the document of each."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~gap
    starts[1:] &= gap[:-1]
    ends = ~gap
    ends[:-1] &= gap[1:]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    starts[cuts] = ~gap[cuts]
    ends[cuts[1:] - 1] = ~gap[cuts[1:] - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values()[_lower()[data]] * up[:n], out=sums[1:])
    value = (sums[last] - sums[first]) * down[first]
    return mix(value + (last - first).astype(np.uint64)), np.searchsorted(offsets, first, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of k words of every document, sorted by document and value, and the document of each.
    A document of fewer words has its whole sequence as one shingle; without words, none."""
    value, owner = words(data, offsets)
    if not len(value):
        return value, owner
    places = [np.uint64(p) for p in _PLACES[:k]] if k <= len(_PLACES) else [np.uint64(pow(BASE, j + 1, 1 << 64)) for j in range(k)]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(first, len(owner)))
    n = len(value) - k + 1
    if n > 0:
        whole = owner[:n] == owner[k - 1 :]
        total = value[:n] * places[0]
        for j in range(1, k):
            total += value[j : j + n] * places[j]
        out, who = mix(total[whole]), owner[:n][whole]
    else:
        out, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = count < k
    if short.any():
        more = np.zeros(int(short.sum()), np.uint64)
        at, size = first[short], count[short]
        for j in range(k - 1):
            has = size > j
            more[has] += value[at[has] + j] * places[j]
        out = np.concatenate([out, mix(more ^ (size.astype(np.uint64) << np.uint64(48)))])
        who = np.concatenate([who, owner[at]])
    order = np.lexsort((out, who))
    out, who = out[order], who[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    return out[new], who[new]
