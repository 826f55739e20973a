"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash resolves every pre-token that is itself in the vocabulary. Tier two: the others are
merged by a heap of adjacent pairs over a doubly linked list of bytes. A pre-token's ids do not depend on its
surroundings, so each worker remembers those it has worked out in a bounded table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import M64
from docveil.llm.pretokens import ODD, Memo

GOLDEN = 0x9E3779B97F4A7C15
SPREAD = 0xD6E8FEB86659FD93
#: Pre-tokens remembered by one worker in each of two generations (about 100 MB each).
REMEMBERED = 500_000
#: The splitting pattern for which QUICK gives the same pre-tokens on text without ODD characters. Fixed values.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QUICK = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: one 64-bit hash a key, one displacement a bucket of about 4 keys."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.m = n, max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        buckets = (hashes >> np.uint64(32)) % np.uint64(self.m)
        order = np.argsort(buckets, kind="stable")
        starts = np.searchsorted(buckets[order], np.arange(self.m + 1))
        self.shift = [0] * self.m
        taken = np.zeros(n, dtype=bool)
        slots = np.zeros(n, dtype=np.int64)
        for b in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
            mine = order[starts[b] : starts[b + 1]]
            if not len(mine):
                break
            first, step = 0, 64
            while True:
                tries = np.arange(first, first + step, dtype=np.uint64)
                at = self._slots(hashes[mine][:, None], tries[None, :])
                good = ~taken[at].any(axis=0)
                if len(mine) > 1:
                    s = np.sort(at, axis=0)
                    good &= (s[1:] != s[:-1]).all(axis=0)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = first + k
                    slots[mine] = at[:, k]
                    taken[at[:, k]] = True
                    break
                first, step = first + step, min(step * 2, 1 << 15)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for i, s in enumerate(slots.tolist()):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = h + d * np.uint64(GOLDEN)
        x ^= x >> np.uint64(32)
        x *= np.uint64(SPREAD)
        return (((x >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        x = (h + self.shift[(h >> 32) % self.m] * GOLDEN) & M64
        x ^= x >> 32
        x = (x * SPREAD) & M64
        s = ((x >> 32) * self.n) >> 32
        return self.values[s] if self.keys[s] == key else -1


NONE = 1 << 62


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merges the adjacent pair of lowest rank, leftmost first.

    `end[i]` is where the part that starts at byte i stops, and so where the next one starts; `before[i]` is where the
    part before it starts; `pair[i]` is the rank of that part joined to the next. A heap entry holds a rank and a
    start; it is stale if `pair` has another rank there by now.
    """
    n, get = len(piece), ranks.get
    pair = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    heap = [r << 32 | i for i, r in enumerate(pair) if r != NONE]
    heapify(heap)
    pair.append(NONE)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    while heap:
        x = heappop(heap)
        i = x & 0xFFFFFFFF
        if pair[i] != x >> 32:
            continue
        j = end[i]
        stop = end[i] = end[j]
        pair[i] = pair[j] = NONE
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                pair[i] = r
                heappush(heap, r << 32 | i)
        if (p := before[i]) >= 0:
            pair[p] = NONE
            if (r := get(piece[p:stop])) is not None:
                pair[p] = r
                heappush(heap, r << 32 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, known: PerfectHash | None = None):
        self.ranks = ranks
        self.known = known or PerfectHash(list(ranks), list(ranks.values()))
        self.pattern, self.usual = regex.compile(pattern), pattern == USUAL
        self.memo = Memo(REMEMBERED)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for k, v in ranks.items():
            tokens[v] = k
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)

    def token(self, text: str) -> bytes:
        """One pre-token's ids, packed: the perfect hash first, the heap for what it does not know."""
        raw = text.encode("utf-8", "surrogatepass")
        r = self.known.get(raw)
        return pack("<i", r) if r >= 0 else np.array(merge(raw, self.ranks), "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        found = [QUICK.findall(t) if self.usual and not ODD.search(t) else self.pattern.findall(t) for t in texts]
        new = self.memo.missing(set().union(*found))
        memo = self.memo.young
        for k in new:
            memo[k] = self.token(k)
        return [b"".join(map(memo.__getitem__, keys)) for keys in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str, known: PerfectHash | None = None) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern, known)
    return _encoders[path, pattern]


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, decoded binary): the BPE ids of every whole text, and the bytes that those ids stand for.

    Null and empty texts give no ids. Repeated rows are encoded each; other columns are left out. `vocabulary` is a
    file that every executor can open; its perfect hash is built once on the driver (its size is the vocabulary's).
    """
    ranks = read_ranks(vocabulary)
    known = df.sparkSession.sparkContext.broadcast(PerfectHash(list(ranks), list(ranks.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, known.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                size = np.cumsum([0, *map(len, ids)]) // 4
                every = np.frombuffer(b"".join(ids), "<i4")
                raw = enc.decode(every)
                ends = np.concatenate([[0], np.cumsum(enc.lengths[every])])[size].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(every, pa.int32())),
                        pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(raw)]),
                    ],
                    names=[id_col, "ids", "decoded"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docveil.llm.common import table

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
