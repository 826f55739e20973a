"""Exact removal of repeated strings over a whole corpus, by sorted suffixes.

Every string of SPAN bytes belongs to an anchor inside it (see `anchors`), so all its copies belong to anchors with the same
gram. Spark gathers anchors by gram. Where the bytes around two anchors are the same, all strings of the later one are copies;
that is read from the bytes in a block of texts, and from two hashes, of 64 bits each, between blocks. The bytes around those that differ are gathered in shards, by gram, and their suffixes are sorted by
external induced sorting; suffixes with SPAN bytes in common are copies of the earliest. A gram with more surroundings than
a shard holds is split before, level by level, by what its windows have around the anchor.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, LongType, StructField, StructType

from docveil.llm.anchors import BLOCK, SPAN, anchors
from docveil.llm.common import blocks, discarded, partitions_for, released, staged, table, utf8
from docveil.llm.induced import suffixes

#: Bytes of anchors' surroundings that are sorted together, about.
SHARD = 1 << 22
#: Bytes of a shard beyond which its text lies on disk.
IN_MEMORY = 1 << 26
SEPARATOR = 255  # is in no UTF-8 text
#: A segment's place in a shard, its document and its `packed`.
RECORD, RECORD_SIZE = "<qqq", 24
NO_ID = -(1 << 63)


def _pack(first: np.ndarray, windows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A first window, the number of windows and the anchor's place after the first window, in one number."""
    return first << 16 | windows << 8 | place - first


def _alike(data: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from each start are those from each other place, for size bytes."""
    out = np.zeros(len(start), bool)
    for lo in range(0, len(start), 1 << 13):
        s, o, n = start[lo : lo + (1 << 13), None], other[lo : lo + (1 << 13), None], size[lo : lo + (1 << 13), None]
        at = np.arange(n.max() if len(n) else 0)
        ok = at < n
        out[lo : lo + (1 << 13)] = (~ok | (data[np.where(ok, s + at, 0)] == data[np.where(ok, o + at, 0)])).all(axis=1)
    return out


def gathered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(copy, gram, cover, key, packed) of all anchors, dealt by gram and sorted by (gram, cover, key, packed).

    Of anchors with the same surroundings that one task meets in a block of texts only the first is dealt by gram; the others
    are known to be copies, byte by byte, and are dealt by key. So what is frequent is one row for each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in blocks(offsets, BLOCK):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, place, gram, first, last, cover = anchors(part, at)
                who, packed = ids[i:j][doc], _pack(first, last - first + 1, place)
                order = np.lexsort((packed, who, cover, gram))
                doc, gram, first, last, cover, who, packed = (c[order] for c in (doc, gram, first, last, cover, who, packed))
                new = np.ones(len(doc), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (cover[1:] != cover[:-1])
                again = np.flatnonzero(~new)
                earliest = np.flatnonzero(new)[np.cumsum(new)[again] - 1]
                start = at[doc] + first
                same = _alike(part, start[again], start[earliest], (last - first + SPAN)[again])
                again, earliest = again[same], earliest[same]
                copy, kept = np.zeros(len(doc), bool), np.ones(len(doc), bool)
                copy[again] = True
                kept[again] = (who[again] != who[earliest]) | (packed[again] != packed[earliest])
                columns = (copy, gram.view(np.int64), cover.view(np.int64), who, packed)
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=["copy", "gram", "cover", "key", "packed"])

    rows = docs.select(F.coalesce(F.col(key), F.lit(NO_ID)).cast("bigint").alias("key"), F.col(text))
    out = rows.mapInArrow(run, "copy boolean, gram bigint, cover bigint, key bigint, packed bigint")
    # of a copy, gram and cover are not needed any more
    out = out.select("copy", F.when(F.col("copy"), F.col("key")).otherwise(F.col("gram")).alias("gram"), F.when(F.col("copy"), F.lit(0)).otherwise(F.col("cover")).alias("cover"), "key", "packed")
    return out.repartition(partitions_for(docs), "gram").sortWithinPartitions("copy", "gram", "cover", "key", "packed")


def compared(rows: DataFrame) -> DataFrame:
    """(gram, key, packed) of anchors whose gram others have: with a null gram those whose surroundings are all copies of
    an earlier anchor's; with the gram the earliest of each different surroundings, if there are several of its gram.

    A gram's anchors are read as a stream. A row that repeats the one before is the same place in a repeated row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row
        alone = None  # the first of the last gram's surroundings, while there are no others
        for batch in batches:
            copy, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if copy.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(int(copy.sum()), pa.int64()), *(pa.array(c[copy]) for c in rest[2:])], names=["gram", "key", "packed"])
            gram, cover, key, packed = (c[~copy] for c in rest)
            n = len(gram)
            if not n:
                continue
            prior = [np.concatenate([c[:1] if before is None else before[i : i + 1], c[:-1]]) for i, c in enumerate((gram, cover, key, packed))]
            start = np.zeros(n, bool)
            start[0] = before is None
            new_gram = start | (gram != prior[0])
            new = new_gram | (cover != prior[1])
            again = ~new & ~((key == prior[2]) & (packed == prior[3]))
            at = np.flatnonzero(new)
            g, k, p = gram[at], key[at], packed[at]
            goes_on = len(at) > 0 and before is not None and g[0] == before[0]
            shown = goes_on and alone is None  # the gram has been seen to have several
            if goes_on and alone is not None:
                g, k, p = (np.concatenate([[a], b]) for a, b in zip(alone, (g, k, p)))
            keep = np.zeros(len(g), bool)
            if len(g):
                keep[1:] |= g[1:] == g[:-1]
                keep[:-1] |= g[1:] == g[:-1]
                if shown:
                    keep |= g == before[0]
                alone = None if keep[-1] else (g[-1], k[-1], p[-1])
            before = np.array([c[-1] for c in (gram, cover, key, packed)])
            kept, copies = np.flatnonzero(keep), np.flatnonzero(again)
            if len(kept) or len(copies):
                none = np.concatenate([np.zeros(len(kept), bool), np.ones(len(copies), bool)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([g[kept], gram[copies]]), mask=none),
                        pa.array(np.concatenate([k[kept], key[copies]])),
                        pa.array(np.concatenate([p[kept], packed[copies]])),
                    ],
                    names=["gram", "key", "packed"],
                )

    return rows.mapInArrow(run, "gram bigint, key bigint, packed bigint")


def surroundings(docs: DataFrame, different: DataFrame, key: str, text: str) -> DataFrame:
    """different with `bytes`: what an anchor's windows cover. Texts and their anchors meet by key, the text first."""
    texts = docs.select(F.coalesce(F.col(key), F.lit(NO_ID)).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("gram"), F.lit(-1).cast("bigint").alias("packed"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.join(_bounded(staged(different.select("key").distinct(), "ids")), "key", "left_semi")
    both = texts.unionByName(different.withColumn("text", F.lit(None).cast("string")))
    both = both.repartition(partitions_for(docs), "key").sortWithinPartitions("key", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw = None, b""
        for batch in batches:
            out = []
            for k, g, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                if t is not None:
                    if k != held or len(t) > len(raw):
                        held, raw = k, t.encode()
                else:
                    first = p >> 16
                    out.append((g, k, p, raw[first : first + (p >> 8 & 255) + SPAN - 1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["gram", "key", "packed", "bytes"])

    return both.select("key", "gram", "packed", "text").mapInArrow(run, "gram bigint, key bigint, packed bigint, bytes binary")


def _bounded(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """ids, to be sent to all executors if they are few (8 bytes each)."""
    return F.broadcast(ids) if ids.count() <= most else ids


class Shard:
    """Surroundings laid end to end, each closed by a separator; beyond IN_MEMORY bytes they are on disk."""

    def __init__(self):
        self.file, self.records = tempfile.SpooledTemporaryFile(IN_MEMORY), tempfile.SpooledTemporaryFile(IN_MEMORY)
        self.size = self.count = 0

    def add(self, key: int, packed: int, raw: bytes) -> None:
        self.records.write(struct.pack(RECORD, self.size, key, packed))
        self.file.write(raw + bytes([SEPARATOR]))
        self.size += len(raw) + 1
        self.count += 1

    def copies(self) -> Iterator[tuple[int, int, int]]:
        """(key, first byte, end) of what is covered by strings of SPAN bytes that have an earlier copy in the shard."""
        if self.count < 2:
            return
        if self.size > IN_MEMORY:
            self.file.rollover()
            self.file.flush()
            text = np.memmap(self.file, np.uint8, "r", shape=(self.size,))
            flags = np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(self.size,))
        else:
            self.file.seek(0)
            text, flags = np.frombuffer(self.file.read(), np.uint8), np.zeros(self.size, bool)
        if self.count * RECORD_SIZE > IN_MEMORY:
            self.records.rollover()
            self.records.flush()
            records = np.memmap(self.records, "<i8", "r", shape=(self.count, 3))
        else:
            self.records.seek(0)
            records = np.frombuffer(self.records.read(), "<i8").reshape(-1, 3)
        starts, keys, packed = (records[:, i] for i in range(3))
        held = [np.zeros(0, np.int64)]  # the suffixes since the last that had less than SPAN in common with the one before

        def mark(place: np.ndarray, group: np.ndarray) -> None:
            segment = np.searchsorted(starts, place, "right") - 1
            after = place - starts[segment]
            ok = after < (packed[segment] >> 8 & 255)
            place, group, segment, after = place[ok], group[ok], segment[ok], after[ok]
            order = np.lexsort(((packed[segment] >> 16) + after, keys[segment], group))
            place, group = place[order], group[order]
            same = np.flatnonzero(group[1:] == group[:-1]) + 1
            flags[place[same]] = True

        for place, common in suffixes(text, SPAN):
            breaks = np.flatnonzero(common < SPAN)
            if not len(breaks):
                held.append(place)
                continue
            whole = np.concatenate([*held, place[: breaks[-1]]])
            starts_new = np.zeros(len(whole), np.int64)
            starts_new[len(whole) - breaks[-1] + breaks[:-1]] = 1
            group = np.cumsum(starts_new)
            size = np.bincount(group, minlength=1) if len(group) else np.zeros(1, np.int64)
            several = size[group] > 1
            if several.any():
                mark(whole[several], group[several])
            held = [place[breaks[-1] :]]
        rest = np.concatenate(held)
        if len(rest) > 1:
            mark(rest, np.zeros(len(rest), np.int64))
        for lo in range(0, self.count, 1 << 14):  # some segments at once
            hi = min(lo + (1 << 14), self.count)
            begin, end = int(starts[lo]), int(starts[hi]) if hi < self.count else self.size
            hit = np.flatnonzero(flags[begin:end]) + begin
            if len(hit):
                segment = lo + np.searchsorted(starts[lo:hi], hit, "right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (segment[1:] != segment[:-1])]))
                last = np.append(cut[1:], len(hit)) - 1
                s = segment[cut]
                first = packed[s] >> 16
                yield from zip(keys[s].tolist(), (first + hit[cut] - starts[s]).tolist(), (first + hit[last] - starts[s] + SPAN).tolist())


def sorted_copies(rows: DataFrame) -> DataFrame:
    """(key, first, end) of copies among surroundings (gram, key, packed, bytes), in shards of whole grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(), None

        def close() -> Iterator[pa.RecordBatch]:
            if found := list(shard.copies()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["key", "first", "end"])

        for batch in batches:
            for g, k, p, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if g != last and shard.size > SHARD:
                    yield from close()
                    shard = Shard()
                last = g
                shard.add(k, p, raw)
        yield from close()

    dealt = rows.select("gram", "key", "packed", "bytes").repartition(partitions_for(rows), "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "key bigint, first bigint, end bigint")


def larger(rows: DataFrame, size: Column) -> DataFrame:
    """(gram) of those whose surroundings, with a separator each, are more than a shard."""
    return staged(rows.groupBy("gram").agg(F.sum(size + 1).alias("n")).where(F.col("n") > SHARD).select("gram"), "larger")


def halved(rows: DataFrame, width: int) -> DataFrame:
    """rows (gram, key, packed, bytes) cut by windows: those with the anchor in the same `width` places stay together, and
    the gram becomes a hash of it, these places and all bytes that windows with the anchor there have in common."""
    last = F.col("packed").bitwiseAND(255)  # the anchor's place in the first window, and in the last one
    least = last - F.shiftright("packed", 8).bitwiseAND(255) + 1
    low = F.transform(F.sequence(F.floor(least / width), F.floor(last / width)), lambda c: c * width)
    cut = rows.withColumn("__last", last).withColumn("__least", least).withColumn("__low", F.explode(low))
    top, low = F.least("__last", F.col("__low") + width - 1), F.greatest("__least", "__low")
    cut = cut.withColumn("__skip", F.col("__last") - top).withColumn("__windows", top - low + 1).withColumn("__top", top)
    shared = F.substring("bytes", (F.col("__last") - F.col("__low") + 1).cast("int"), F.lit(SPAN - width + 1))
    return cut.select(
        F.xxhash64("gram", F.lit(width), "__low", shared).alias("gram"),
        "key",
        F.shiftleft(F.shiftright("packed", 16) + F.col("__skip"), 16).bitwiseOR(F.shiftleft(F.col("__windows"), 8)).bitwiseOR(F.col("__top")).alias("packed"),
        F.substring("bytes", (F.col("__skip") + 1).cast("int"), (F.col("__windows") + SPAN - 1).cast("int")).alias("bytes"),
    )


def split_copies(rows: DataFrame) -> list[DataFrame]:
    """Tables of (key, first, end) of copies among surroundings (gram, key, packed, bytes) of grams larger than a shard.
    What still is larger when its windows have the anchor in one place is one window, found again and again."""
    out, held, width = [], None, 64
    while True:
        halves = staged(halved(rows, width), "halves")
        if held is not None:
            discarded(held)
        rows = held = halves
        if width == 1:
            place = F.struct("key", F.shiftright("packed", 16).alias("first"))
            earliest = rows.groupBy("gram", "bytes").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            later = rows.join(earliest, ["gram", "bytes"]).where(place > F.col("earliest"))
            return [*out, staged(later.select("key", F.shiftright("packed", 16).alias("first"), (F.shiftright("packed", 16) + SPAN).alias("end")), "copies")]
        hot = larger(rows, F.length("bytes"))
        if hot.isEmpty():
            return [*out, staged(sorted_copies(rows), "copies")]
        out.append(staged(sorted_copies(rows.join(_bounded(hot), "gram", "left_anti")), "copies"))
        rows, width = rows.join(_bounded(hot), "gram", "left_semi"), width // 2


def removed(docs: DataFrame, spans: DataFrame, key: str, text: str, characters: bool, carry: str) -> DataFrame:
    """(carry, n_bytes, n_removed, n_spans, kept) of every document, without the bytes in spans (key, first, end); with
    `characters`, kept is also without what is left of characters that were cut in two."""
    kind = docs.schema[carry].dataType
    texts = docs.select(F.coalesce(F.col(key), F.lit(NO_ID)).cast("bigint").alias("key"), F.col(carry).alias("id"), F.lit(0).alias("own"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("end"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    more = spans.select("key", F.lit(None).cast(kind).alias("id"), F.lit(-1).alias("own"), "first", "end", F.lit(None).cast("string").alias("text"))
    both = texts.unionByName(more).repartition(partitions_for(docs), "key").sortWithinPartitions("key", "own", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cuts = None, []
        for batch in batches:
            rows = []
            for i, (k, own, first, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)))):
                if k != held:
                    held, cuts = k, []
                if own:
                    if cuts and first <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], end)
                    else:
                        cuts.append([first, end])
                    continue
                raw = batch.column(5)[i].as_py().encode()
                here = [(a, min(b, len(raw))) for a, b in cuts if a < len(raw)]
                parts, at = [], 0
                for a, b in here:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                gone = len(raw) - len(kept)
                if characters and here:
                    kept = kept.decode("utf-8", "ignore").encode()
                rows.append((batch.column(1)[i].as_py(), len(raw), gone, len(here), kept))
            if rows:
                kinds = (batch.schema.field(1).type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[carry, "n_bytes", "n_removed", "n_spans", "kept"])

    counts = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    out = StructType([StructField(carry, kind), *counts, StructField("kept", BinaryType())])
    return both.select("key", "id", "own", "first", "end", "text").mapInArrow(run, out)


def by_row(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with a key that tells rows of different texts apart, in the order of the key, and its name: the key itself, unless
    some rows repeat it with other texts."""
    hashed = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    if hashed.groupBy("id").agg((F.min("h") != F.max("h")).alias("differ")).where("differ").isEmpty():
        return docs, key
    # numbers ascend with the order of the rows; written once, so that all stages see the same
    rows = staged(hashed.distinct().orderBy(F.asc_nulls_first("id"), "h").withColumn("row", F.monotonically_increasing_id()), "rows")
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    met = docs.join(rows.withColumnsRenamed({"id": "__id", "h": "__h", "row": "__row"}), F.col(key).eqNullSafe(F.col("__id")) & (own == F.col("__h")))
    return staged(met.drop("__id", "__h"), "docs"), "__row"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", characters: bool = False, carry: str | None = None) -> DataFrame:
    """(carry, n_bytes, n_removed, n_spans, kept binary) of every document: its UTF-8 without each byte that is covered by a
    string of SPAN bytes which also starts earlier, in a document of smaller key or before in the same one.

    Null texts count as empty. Rows that repeat a key and its text are one document, judged once and returned for each; with
    other texts they are other documents, in the order of their texts' hashes. A null key is the smallest. With `characters`,
    characters that would be left in part are left out of `kept`, which then is UTF-8. `carry` names the column that comes
    back with each row, the key if it is not given. Keys are whole numbers.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} holds no whole numbers")
    carry = carry or key
    docs, key = by_row(docs, key, text)
    found = staged(compared(gathered(docs, key, text)), "anchors")
    released(docs.sparkSession)
    whole = found.where("gram is null").select("key", F.shiftright("packed", 16).alias("first"), (F.shiftright("packed", 16) + F.shiftright("packed", 8).bitwiseAND(255) + SPAN - 1).alias("end"))
    different, split = found.where("gram is not null"), []
    hot = larger(different, F.shiftright("packed", 8).bitwiseAND(255) + SPAN - 1)
    if not hot.isEmpty():
        split = split_copies(surroundings(docs, different.join(_bounded(hot), "gram", "left_semi"), key, text))
        different = different.join(_bounded(hot), "gram", "left_anti")
        released(docs.sparkSession)
    partly = staged(sorted_copies(surroundings(docs, different, key, text)), "copies")
    released(docs.sparkSession)
    return removed(docs, reduce(DataFrame.union, [partly, *split], whole), key, text, characters, carry)


def op3(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
