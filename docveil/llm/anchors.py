"""Anchors: a local choice of positions such that equal strings of SPAN bytes contain the same anchor at the same place."""

from __future__ import annotations

from functools import cache

import numpy as np

from docveil.llm.common import mix

#: The length of the strings, and of the grams whose hashes choose the anchors.
SPAN, GRAM = 100, 20
RUN = SPAN - GRAM + 1
BASE = 0xD1342543DE82EF95
BLOCK = 1 << 19


@cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `strings` has the hash of any substring."""
    up, _ = _powers(1 << max(19, int(len(data)).bit_length()))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_values()[data] * up[: len(data)], out=out[1:])
    return out


def strings(prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings from first to end."""
    _, down = _powers(1 << max(19, int(len(prefix) - 1).bit_length()))
    return mix((prefix[end] - prefix[first]) * down[first] + (end - first).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, hash of its gram, first window, last window, hash of all they cover) of every anchor.

    A window is a string of SPAN bytes within one document; its anchor is the leftmost gram of least hash in it. The
    windows of an anchor are consecutive. Places count from the document's start.
    """
    n = len(data) - SPAN + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64, np.uint64))
    prefix = sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = strings(prefix, at, at + GRAM)
    # the high bits of the hash, then the place, so that the least is also leftmost
    bits = int(len(gram)).bit_length()
    key = (gram >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    least, d = key, 1
    while d < RUN:
        step = min(d, RUN - d)
        least = np.minimum(least[:-step], least[step:])
        d += step
    chosen = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - SPAN + 1) : end] = False
    window = np.flatnonzero(inside)
    chosen = chosen[window]
    doc = np.searchsorted(offsets, window, "right") - 1
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    place, lo, hi, who = chosen[first], window[first], window[last], doc[first]
    cover = strings(prefix, lo, hi + SPAN) ^ mix((place - lo).astype(np.uint64))
    start = offsets[who]
    return who, place - start, gram[place], lo - start, hi - start, cover
