"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier for each bit, over hashed byte n-grams of the lower-cased text,
says which half of the languages the text looks like. Decoding weights each bit's loss by how sure its classifier is and
takes the nearest codeword; where the second nearest is about as near, the answer is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from docveil.llm.common import blocks, partitions_for, staged, table, utf8

UNDETERMINED = "und"
#: Buckets of hashed n-grams, and the n.
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
#: About so many labelled documents of each language are learnt from at most: those with the smallest hashes of their ids.
SAMPLE = 4000
#: Counts of n-grams by language that a task holds at once.
HELD = 1 << 22
#: Additive smoothing of n-gram frequencies, in counts.
SMOOTHING = 0.5
#: Two codewords whose scores differ by less are ambiguous.
MARGIN = 0.02
BLOCK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1. All ways to halve the languages for up to 6 of them; else random columns, at least 10 log2 n,
    whose rows differ pairwise in a third of the bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=float).T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(n)
    while True:
        code = np.where(rng.permuted(np.tile(np.arange(n) * 2 < n, (bits, 1)), axis=1), 1.0, -1.0).T
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() >= bits / 3:
            return code
        bits += 1


def grams(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of documents laid end to end, with the document of each. A gram over a document's end is left out.
    ASCII capitals count as lower case, and everything that is not a letter byte as a space."""
    kinds = _kinds()
    data = kinds[text].astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(257) + data[k : len(data) - n + 1 + k]
        same = doc[: len(code)] == doc[n - 1 :]
        code = (code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(17)
        values.append(code[same])
        owners.append(doc[: len(code)][same])
    if not values:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(owners)


def _kinds() -> np.ndarray:
    kinds = np.full(256, 32, dtype=np.uint8)
    kinds[ord("a") : ord("z") + 1] = kinds[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    kinds[128:] = np.arange(128, 256)
    return kinds


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits: log odds of a bit's two halves for one n-gram

    def margins(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """documents x bits: each bit's mean log odds by n-gram."""
        n = len(offsets) - 1
        values, owners = grams(text, offsets)
        out = np.zeros((n, self.code.shape[1]))
        count = np.maximum(1, np.bincount(owners, minlength=n))
        for bit in range(out.shape[1]):
            out[:, bit] = np.bincount(owners, self.weights[values, bit], n) / count
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: the nearest codeword, its score from 0 to 1, whether another is about as near.

        A bit's loss is log(1 + exp(-c m)) for code c and margin m, so unsure bits weigh little; the score is the softmin
        of the losses.
        """
        sharp = 20.0 * margins
        loss = np.stack([np.logaddexp(0.0, -c * sharp).sum(axis=1) for c in self.code], axis=1)
        likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
        likely /= likely.sum(axis=1, keepdims=True)
        ranked = np.sort(likely, axis=1)
        second = ranked[:, -2] if likely.shape[1] > 1 else np.zeros(len(likely))
        return likely.argmax(axis=1), ranked[:, -1], ranked[:, -1] - second < MARGIN


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """Learns all labels, from rows with a text and a label, about SAMPLE of each at most.

    What is collected is the labels with their numbers, and one sum for each bucket and bit, whose number grows with the
    logarithm of the number of labels.
    """
    rows = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    sizes = rows.groupBy("label").count()
    languages = sorted(r["label"] for r in sizes.select("label").collect())
    if not languages:
        return Model([], codewords(0), np.zeros((BUCKETS, 1)))
    code, at = codewords(len(languages)), {name: i for i, name in enumerate(languages)}
    # the SAMPLE smallest hashes of each label, found without moving texts; there are no more labels than the driver holds
    share = sizes.select("label", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("count")).alias("share"))
    rows = rows.join(F.broadcast(share), "label").where(F.xxhash64("key").cast("double") / 2.0**64 + 0.5 <= F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, n = (np.concatenate(c) for c in zip(*held))
            values, of = np.unique(keys, return_inverse=True)
            sums = np.bincount(of, n, len(values)).astype(np.int64)
            columns = ((values // BUCKETS).astype(np.int32), (values % BUCKETS).astype(np.int32), sums)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "bucket", "n"])

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            labels = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j in blocks(offsets, BLOCK):
                values, owners = grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(np.unique(labels[i:j][owners] * BUCKETS + values, return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counts = staged(rows.select("label", "text").mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    totals = np.zeros(len(languages))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]
    totals += SMOOTHING * BUCKETS

    def by_bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over the languages of either half of a bit of an n-gram's frequency, all that is beyond smoothing."""
        plus, minus = (np.zeros((BUCKETS, code.shape[1])) for _ in range(2))
        for batch in batches:
            lang, bucket, n = (c.to_numpy() for c in batch.columns)
            for k in np.unique(lang):
                mine = lang == k
                part = (n[mine] / totals[k])[:, None]
                plus[bucket[mine]] += part * (code[k] > 0)
                minus[bucket[mine]] += part * (code[k] < 0)
        some, bit = np.nonzero(plus + minus)
        columns = (some.astype(np.int32), bit.astype(np.int32), plus[some, bit], minus[some, bit])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "bit", "plus", "minus"])

    dealt = counts.repartition(partitions_for(counts), "bucket").mapInArrow(by_bit, "bucket int, bit int, plus double, minus double")
    got = dealt.groupBy("bucket", "bit").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus")).toArrow()
    halves = []
    for name, sign in (("plus", 1), ("minus", -1)):
        half = code * sign > 0
        sums = np.zeros((BUCKETS, code.shape[1]))
        sums[got["bucket"].to_numpy(), got["bit"].to_numpy()] = got[name].to_numpy()
        halves.append((sums + ((SMOOTHING / totals)[:, None] * half).sum(axis=0)) / np.maximum(1, half.sum(axis=0)))
    both = (halves[0] > 0) & (halves[1] > 0)  # a lone language has bits with one half
    weights = np.where(both, np.log(np.where(both, halves[0], 1)) - np.log(np.where(both, halves[1], 1)), 0.0)
    return Model(languages, code, weights)


def predict(df: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred, score, ambiguous of every row, from its whole text alone. keys have other names than these three.

    A text that is null or has no letter, or a model without languages, gives `und` with score 0, not ambiguous.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            raw, offsets = utf8(column)
            margins = [m.margins(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets, BLOCK)]
            if not margins:
                continue
            has = np.array([bool(t) and LETTER.search(t) is not None for t in column.to_pylist()])
            if m.languages:
                best, score, ambiguous = m.decode(np.concatenate(margins))
            else:
                best, score, ambiguous, has = np.zeros(len(has), int), np.zeros(len(has)), np.zeros(len(has), bool), np.zeros(len(has), bool)
            names = np.array([*m.languages, UNDETERMINED], dtype=object)[np.where(has, best, len(m.languages))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(ambiguous & has)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"],
            )

    if clash := {"lang_pred", "score", "ambiguous"}.intersection(keys):
        raise ValueError(f"keys named like results: {sorted(clash)}")
    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    kinds = StructType([*(StructField(k, df.schema[k].dataType) for k in keys), *more])
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, kinds)


def held_out(key: str = "doc_id") -> Column:
    """Every fifth document by the checksum of its id's text is not learnt from."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.withColumn("held_out", held_out()), fit(docs.where(~held_out())), keys=("doc_id", "held_out"))
