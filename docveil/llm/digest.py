"""Document fingerprints by improbable features.

Every window of 64 bytes has an entropy; how rare that entropy is in the corpus ranks the window. A window that is the
rarest of its surroundings often enough is a selected feature. Features are inserted, in order, into a chain of Bloom
filters; two chains are compared by the overlap of their filters' bits beyond what chance gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import blocks, mix, partitions_for, table, utf8

WINDOW = 64
#: Entropies are kept in thousandths of the largest one; windows below WEAK of it (runs of few bytes) rank last.
STEPS = 1000
WEAK = 100
#: A window is selected if it is the rarest of so many runs of WINDOW neighbouring windows.
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Overlap within so many standard deviations of what unrelated filters of the same fullness have is no likeness; but at most
#: this share of the way from chance to full overlap.
SIGMAS = 4
CUT = 0.3
BLOCK = 1 << 18
STRIP = 1 << 16

_C_LOG_C = np.array([0, *(round(c * np.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1))], dtype=np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy steps (0 to STEPS) of every window of data. From a window to the next, only the counts of the byte that
    leaves and of the one that enters change; both counts come from comparing data with itself at each distance."""
    n = len(data) - WINDOW + 1
    out = np.empty(max(0, n), np.uint16)
    for lo in range(0, n, STRIP):
        s = data[lo : lo + STRIP + WINDOW - 1]
        m = len(s) - WINDOW + 1
        leaving, entering = np.ones(len(s), np.uint8), np.zeros(len(s), np.uint8)
        same = np.empty(len(s), bool)
        for d in range(1, WINDOW):
            k = len(s) - d
            np.equal(s[:k], s[d:], out=same[:k])
            hit = same[:k].view(np.uint8)
            np.add(leaving[:k], hit, out=leaving[:k])
            np.add(entering[d:], hit, out=entering[d:])
        gone, come = leaving[: m - 1], entering[WINDOW:]
        change = _C_LOG_C[gone - 1] - _C_LOG_C[gone] + _C_LOG_C[come + 1] - _C_LOG_C[come]
        total = np.empty(m, np.int64)
        total[0] = _C_LOG_C[np.bincount(s[:WINDOW], minlength=256)].sum()
        np.cumsum(change, out=total[1:])
        total[1:] += total[0]
        full = int(_C_LOG_C[WINDOW])
        out[lo : lo + m] = (full - total) * STEPS // full
    return out


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each entropy step by how few windows of all documents have it (rarest first; weak ones last)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets, BLOCK):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                total += np.bincount(entropies(part)[_inside(at)], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1, dtype=np.int32)), pa.array(total)], names=["step", "n"])

    counted = docs.select(text).mapInArrow(count, "step int, n bigint").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(STEPS + 1, np.int64)
    counts[counted["step"].to_numpy()] = counted["n"].to_numpy()
    order = np.lexsort((np.arange(STEPS + 1), counts, np.arange(STEPS + 1) < WEAK))
    ranks = np.empty(STEPS + 1, np.uint16)
    ranks[order] = np.arange(STEPS + 1)
    return ranks


def _inside(offsets: np.ndarray) -> np.ndarray:
    """Which windows of documents laid end to end lie in one document."""
    n = int(offsets[-1]) - WINDOW + 1
    ok = np.ones(max(0, n), bool)
    for end in offsets[1:-1]:
        ok[max(0, end - WINDOW + 1) : end] = False
    return ok


def selected(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the selected windows, in order, and the document of each. A document in which no window is popular
    enough has its rarest one; a document shorter than a window has none here."""
    n = len(data) - WINDOW + 1
    docs = np.flatnonzero(np.diff(offsets) >= WINDOW)
    if n <= 0 or not len(docs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _inside(offsets)
    bits = max(1, int(n).bit_length())
    kind = np.uint32 if bits + 10 <= 32 else np.uint64
    key = (ranks[entropies(data)].astype(kind) << kind(bits)) | np.arange(n, dtype=kind)
    key[~inside] = np.iinfo(kind).max
    least = key
    for d in (1, 2, 4, 8, 16, 32):  # least of 2, 4, ... 64 neighbours
        least = np.minimum(least[:-d], least[d:]) if len(least) > d else least[:0]
    # runs of neighbours within one document
    firsts, lasts = offsets[docs], offsets[docs + 1] - WINDOW  # of its windows
    runs = np.zeros(len(least) + 1, np.int8)
    whole = lasts - firsts >= WINDOW - 1
    np.add.at(runs, firsts[whole], 1)
    np.add.at(runs, lasts[whole] - WINDOW + 2, -1)
    chosen = least[np.cumsum(runs[:-1]) > 0] & kind((1 << bits) - 1)
    popularity = np.bincount(chosen, minlength=n)
    starts = np.flatnonzero(popularity >= POPULAR)
    owner = np.searchsorted(offsets, starts, "right") - 1
    without = docs[~np.isin(docs, owner)]
    if len(without):
        mask = kind((1 << bits) - 1)
        more = np.array([int(key[offsets[d] : offsets[d + 1] - WINDOW + 1].min() & mask) for d in without], np.int64)
        starts, owner = np.concatenate([starts, more]), np.concatenate([owner, without])
        order = np.argsort(starts, kind="stable")
        starts, owner = starts[order], owner[order]
    return starts, owner


def hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(data[starts[:, None] + np.arange(WINDOW)]).view("<u8")
    out = np.full(len(starts), 0x243F6A8885A308D3, np.uint64)
    for k in range(words.shape[1]):
        out = mix(out ^ words[:, k]) + np.uint64(k)
    return mix(out)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Of each text its chain of filters, as rows of FILTER_BITS / 8 bytes; no rows for the empty text. A text shorter
    than a window is one feature, padded with zero bytes."""
    out: list[np.ndarray] = []
    sizes = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for i, j in blocks(sizes, BLOCK):
        part, offsets = data[sizes[i] : sizes[j]], sizes[i : j + 1] - sizes[i]
        starts, owner = selected(part, offsets, ranks)
        values = hashes(part, starts) if len(starts) else np.zeros(0, np.uint64)
        short = [d for d in range(j - i) if 0 < offsets[d + 1] - offsets[d] < WINDOW]
        if short:
            rows = np.zeros((len(short), WINDOW), np.uint8)
            for k, d in enumerate(short):
                rows[k, : offsets[d + 1] - offsets[d]] = part[offsets[d] : offsets[d + 1]]
            values = np.concatenate([values, hashes(rows.reshape(-1), np.arange(len(short)) * WINDOW)])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            values, owner = values[order], owner[order]
        # a feature that a document has twice counts once, at its first place
        by_value = np.lexsort((np.arange(len(values)), values, owner))
        new = np.ones(len(values), bool)
        new[by_value[1:]] = (values[by_value[1:]] != values[by_value[:-1]]) | (owner[by_value[1:]] != owner[by_value[:-1]])
        values, owner = values[new], owner[new].astype(np.int64)
        count = np.bincount(owner, minlength=j - i)
        filters = -(-count // FILTER_FEATURES)
        base = np.concatenate([[0], np.cumsum(filters)])
        ordinal = np.arange(len(values)) - np.concatenate([[0], np.cumsum(count)])[owner]
        row = base[owner] + ordinal // FILTER_FEATURES
        bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
        for k in range(HASHES):
            bits[row, (values >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[base[d] : base[d + 1]] for d in range(j - i)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, averaged."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    ones = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    for row in a:
        mine = int(np.bitwise_count(row).sum(dtype=np.int64))
        both = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        full = np.minimum(mine, ones)
        chance = mine * ones / FILTER_BITS
        spread = np.sqrt(chance * (1 - ones / FILTER_BITS) * (1 - mine / FILTER_BITS))
        floor = chance + np.minimum(SIGMAS * spread, CUT * (full - chance))
        total += float(np.clip((both - floor) / np.maximum(full - floor, 1e-9), 0, 1).max())
    return total / len(a)


def shown(chain: np.ndarray) -> str:
    """The number of filters and their bits in base64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, tail, key, text): documents dealt into ranges of descending key, sorted in each. After a range's own
    documents comes, as its tail, the first one of the next range that has any; after the last range, that of the first.

    Only the first keys of the ranges, one for each bucket, are collected.
    """
    spark, n = docs.sparkSession, partitions_for(docs)
    number = F.coalesce(-F.col("__key").cast("double"), F.lit(float("inf")))
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__number", number)
    bounds = sorted(set(rows.where("__key is not null").approxQuantile("__number", [i / n for i in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="__number", outputCol="__bucket").transform(rows).drop("__number").withColumn("__bucket", F.col("__bucket").cast("int"))
    firsts = sorted((r["__bucket"], r["__key"]) for r in rows.groupBy("__bucket").agg(F.max("__key").alias("__key")).collect())
    kind = rows.schema["__key"].dataType.simpleString()
    follows = [(firsts[i - 1][0], b, k) for i, (b, k) in enumerate(firsts)]
    heads = spark.createDataFrame(follows, f"__before int, __bucket int, __key {kind}")
    same = (rows["__bucket"] == heads["__bucket"]) & rows["__key"].eqNullSafe(heads["__key"])
    tails = rows.join(F.broadcast(heads), same).select(F.col("__before").alias("__bucket"), F.lit(1).alias("__tail"), rows["__key"], "__text")
    every = rows.select("__bucket", F.lit(0).alias("__tail"), "__key", "__text").unionByName(tails)
    order = ["__bucket", "__tail", F.col("__key").desc_nulls_last(), F.xxhash64("__text"), F.length("__text")]
    return every.repartitionById(n, F.col("__bucket")).sortWithinPartitions(*order)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that of the next lower key (of equal keys, that of the next text hash); after the last comes the
    first, and a lone document follows itself. Null texts count as empty. Keys are numbers (others are in one range, which is
    one task). Texts of any length are read whole, a strip at a time; one text's windows are held at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held, bucket = shared.value, None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                chains = digests([t.encode() for t in part.column(3).to_pylist()], ranks)
                pairs = []
                for i, (b, tail, k, t) in enumerate(zip(*(c.to_pylist() for c in part.columns))):
                    if b == bucket and held is not None:
                        pairs.append((held, (k, t, chains[i])))
                    held, bucket = (None if tail else (k, t, chains[i])), b
                if pairs:
                    texts = [edited(a[1], b[1]) for a, b in pairs]
                    others = digests([t.encode() for t in texts], ranks)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([a[0] for a, _ in pairs], part.column(2).type),
                            pa.array([a[1] for a, _ in pairs], pa.string()),
                            pa.array(texts, pa.string()),
                            pa.array([shown(a[2]) for a, _ in pairs], pa.string()),
                            pa.array([shown(o) for o in others], pa.string()),
                            pa.array([likeness(a[2], o) for (a, _), o in zip(pairs, others)], pa.float64()),
                            pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                        ],
                        names=[key, text, "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )

    kind = docs.schema[key].dataType.simpleString()
    return in_order(docs, key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints(docs, rarity(docs)).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
