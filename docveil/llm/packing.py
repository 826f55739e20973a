"""Token pieces and their packing into sequences by shortest-pack-first over the length histogram.

Documents are cut at multiples of the capacity. What is collected is the histogram of piece lengths, at most `capacity`
numbers. Over it, lengths are placed longest first into the packs that have the most room, as counts of packs with the
same pattern, never pack by pack. Each pattern then says which ranks of each length it takes, and pieces, ranked within
their length by Spark, join it by length and rank.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.common import staged, table
from docveil.llm.pretokens import ODD, Memo

CAPACITY = 4096
END_ID = 2
#: Pieces of one length that are ranked together in one group, about.
RANKED = 200_000
#: Pre-tokens remembered by one worker in each of two generations.
REMEMBERED = 400_000
#: Words of the vocabulary's own splitting pattern, on lower-cased text without ODD characters. A fixed value.
WORDS = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")
#: How the vocabulary marks the last part of a word. A fixed value.
WORD_END = "</w>"


class Tokens:
    """Ids of whole texts by a `tokenizers` file whose parts end words with WORD_END, as that library gives them.

    A word's ids do not depend on its neighbours, so words are encoded once and remembered. Texts with characters for
    which WORDS is not known to split alike, or in which an added token of the file is spelt out, go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.memo = Memo(REMEMBERED)

    def _learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            ids = np.array(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, at = ids.tobytes(), 0
                for w, stop in zip(part, (4 * stops).tolist()):
                    self.memo.young[w] = raw[at:stop]
                    at = stop
            else:
                for w in part:
                    self.memo.young[w] = self._exact(w)

    def _exact(self, text: str) -> bytes:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [None if ODD.search(t) or self.added.search(t) else WORDS.findall(t.lower()) for t in texts]
        self._learn(self.memo.missing(set().union(*(k for k in found if k is not None))))
        memo = self.memo.young
        return [self._exact(t) if k is None else b"".join(map(memo.__getitem__, k)) for t, k in zip(texts, found)]


_tokens: dict[str, Tokens] = {}


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, start, length, ids binary, doc_tokens): every whole text's ids and a closing END_ID, cut at multiples of
    `capacity`. ids are little-endian unsigned 32-bit. Null and empty texts have just END_ID. Repeated rows are cut each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows: list[tuple] = []
                for key, raw in zip(part.column(0), _tokens[path].encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    rows += [(key, at // 4, min(step, len(raw) - at) // 4, raw[at : at + step], len(raw) // 4) for at in range(0, len(raw), step)]
                columns = list(zip(*rows))
                kinds = (part.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64())
                keys = pa.array([k.as_py() for k in columns[0]], kinds[0])
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns[1:], kinds[1:]))], names=[id_col, "start", "length", "ids", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")


def runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Shortest-pack-first: rows (length, first rank, stride, ranks, times, first sequence, offset).

    For k < times the pieces of that length with `ranks` ranks from first rank + k * stride on go, in order, to consecutive
    sequences at offset + k * length. Where no pack has room, just as many are opened as the length's pieces fill.
    """
    packs: list[tuple[int, int, int, int, tuple]] = []  # (-room, order, packs, first sequence, items)
    order = sequences = 0
    done = []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if not packs or -packs[0][0] < length:
                many = -(-left // (capacity // length))
                order += 1
                heapq.heappush(packs, (-capacity, order, many, sequences, ()))
                sequences += many
            # packs whose rooms differ by less than a piece take pieces in turn
            turn, total, least = [], 0, max(length, 1 - packs[0][0] - length)
            while total < left and packs and -packs[0][0] >= least:
                turn.append(heapq.heappop(packs))
                total += turn[-1][2]
            room = -turn[-1][0]
            times = min(left // total, room // length)
            if packs:  # until a pack outside has as much room
                times = min(times, -(-(room + packs[0][0]) // length))
            times = max(1, times)
            for room, _, many, first, items in turn:
                room, take = -room, min(left, many)
                if take < many:  # the packs that get none keep their pattern, from a later rank on
                    order += 1
                    later = tuple((n, r + take, s, t, o) for n, r, s, t, o in items)
                    heapq.heappush(packs, (-room, order, many - take, first + take, later))
                order += 1
                entry = (times * length - room, order, take, first, (*items, (length, rank, take, times, capacity - room)))
                if room > times * length:
                    heapq.heappush(packs, entry)
                else:
                    done.append(entry)
                rank, left = rank + take * times, left - take * times
    return [(n, r, s, many, t, first, o) for _, _, many, first, items in [*packs, *done] for n, r, s, t, o in items]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """runs one by one: rows (length, first rank, ranks, first sequence, offset).

    The pieces of that length with those ranks go, in order, to consecutive sequences at that offset.
    """
    return [(n, r + k * s, many, first, o + k * n) for n, r, s, many, t, first, o in runs(histogram, capacity) for k in range(t)]


def pack(rows: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """rows (with `length` from 1 to capacity) with sequence_id and offset; every row lies in exactly one sequence.

    rows should come from a written table, as they are read three times. Rows equal in all columns may change places.
    """
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a length is outside of 1 to the capacity")
    kind = "length bigint, first_rank bigint, stride bigint, ranks bigint, times bigint, first_sequence bigint, offset bigint"
    slots = spark.createDataFrame(runs(counts, capacity), kind)
    # ranks within a length, in salted groups so that a frequent length is not one task
    salts = max(1, -(-sum(counts.values()) // RANKED))
    order = [*keys, *sorted(c for c in rows.columns if c not in (*keys, "length"))]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = salted.withColumn("__rank", F.row_number().over(within)).join(sizes, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__before"))
    # slots are bounded by the capacity: at most two patterns are opened for each length
    past = ranked["__rank"] - slots["first_rank"]
    at, turn = past % slots["stride"], F.floor(past / slots["stride"])
    fits = (ranked["length"] == slots["length"]) & (past >= 0) & (past < slots["stride"] * slots["times"]) & (at < slots["ranks"])
    out = ranked.join(F.broadcast(slots), fits).withColumn("sequence_id", slots["first_sequence"] + at)
    out = out.withColumn("__offset", slots["offset"] + turn * slots["length"])
    return out.select(*(ranked[c] for c in rows.columns), "sequence_id", F.col("__offset").alias("offset"))


def op2(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(staged(cut, "pieces"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
