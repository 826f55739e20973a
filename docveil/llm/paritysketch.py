"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into blocks; a block's word is the XOR of its shingles' hashes, so two
documents' words differ in at most as many blocks as their sets differ in shingles. In a band of set sizes, a similarity of
at least t allows at most d differing shingles; so of the non-empty blocks in a fixed order, the first d + 1 of two linked
documents have a word in common (pigeonhole). Spark joins documents on (band, block, word). Candidates are held against
each other by their sketches, bit strings in which every shingle flips one bit and whose Hamming distance is at most the
number of differing shingles, and then on the whole sets. Sets of fewer than FEW shingles are one band in which every
shingle has a block of its own.

Every document gives more blocks than it must, so linked documents share at least `required` keys. So pairs of a bucket
that share fewer are not checked. And of a document's keys that others have too, in order of how many have them, only the
first need to meet: all but one less than it must share, which is more with a larger partner than with a smaller one.
Documents that share less with all others together drop out, and frequent words (of a passage that many documents share)
meet only where a document has hardly any others.

Candidates in a component already need no check. So each bucket first checks its members against the one that meets most
others, then against another, and only in buckets that still hold several components the pairs between these meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.common import blocks, discarded, mix, partitions_for, released, staged, table, utf8
from docveil.llm.shingles import BLOCK, WORDS, shingles

#: The similarity from which documents link, as a fraction.
TOP, BELOW = 75, 100
#: Largest set size over the smallest in a band.
BAND = 2
#: Smaller sets give all their shingles.
FEW = 256
#: Blocks of a band for each differing shingle that its largest sets may have.
WIDTH = 1.8
#: Blocks that a document gives, for each that it must give.
SPARE = 1.25
#: Larger linked sets of n shingles or more share more than n over this keys. Spare blocks are SPARE - 1 of 2 / 7 of n or
#: more, which is n / 14; the rest is room for chance.
SURE = 20
#: Bits of a sketch for each shingle, at least.
SKETCH = 4
#: Bits of the folded sketch that rows carry into the join of first keys, and the names of its 64-bit words.
FOLDED = 512
FLIPS = [f"f{j}" for j in range(FOLDED // 64)]
#: Chooses a shingle's bit.
FLIP = np.uint64(0xA54FF53A5F1D36F1)
#: Tables of up to so many ids are sent to all executors (8 bytes each).
SMALL = 1_000_000


def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles in one set only, of two linked sets of these sizes: from BELOW * i >= TOP * u, i + u = a + b."""
    return (a + b) * (BELOW - TOP) // (BELOW + TOP)


def bands(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(band, is in it) of each size from FEW on: band k has the sizes from BAND**k below BAND**(k + 1), and those smaller
    ones that may link to one of them."""
    own = np.floor(np.log2(np.maximum(n, 1)) / np.log2(BAND) + 1e-9).astype(np.int64)
    upper = own + 1
    reaches = n * BELOW >= TOP * BAND**upper
    return [(own, n >= FEW), (upper, reaches & (n >= FEW))]


def required(a, b):
    """Keys that linked sets of these sizes (columns) share at least: of small sets, at least TOP / (TOP + BELOW) of a + b."""
    most = F.ceil((a + b) * TOP / (TOP + BELOW))
    return F.when(F.least(a, b) < FEW, most).otherwise(F.floor(F.least(a, b) / SURE) + 1)


def surely(n, smaller: bool):
    """Keys that a set of this size shares at least with each linked one, if it is the smaller or else the larger one."""
    most = F.ceil(n * (2 * TOP) / (TOP + BELOW)) if smaller else F.ceil(n * TOP / BELOW)
    return F.when(n < FEW, most).otherwise(F.floor((n if smaller else n * TOP / BELOW) / SURE) + 1)


def keys(value: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys (band, block and word in one hash) of documents' sorted shingles, and the document of each."""
    n = np.bincount(owner, minlength=docs)
    few = (n * TOP < FEW * BELOW)[owner]  # those that may link to a set of fewer than FEW
    out, who = [mix(value[few] ^ np.uint64(0x3C6EF372FE94F82B))], [owner[few]]
    for band, has in bands(n):
        largest = BAND ** (band + 1) - 1
        partner = np.minimum(n * BELOW // TOP, largest)
        needed = allowed(n, partner) + 1
        give = np.ceil(needed * SPARE).astype(np.int64)
        width = np.ceil((allowed(largest, largest) + 1) * WIDTH).astype(np.int64)
        mine = has[owner]
        v, w = value[mine], owner[mine]
        if not len(v):
            continue
        # a block's word is the XOR of what its shingles hash to, apart from the bits that choose the block
        block = ((mix(v) >> np.uint64(32)) * width[w].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = w * (int(width.max()) + 1) + block
        order = np.argsort(place, kind="stable")
        place, word = place[order], mix(v + np.uint64(0x632BE59BD9B4E019))[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        word = np.bitwise_xor.reduceat(word, first)
        w, block = w[order][first], block[order][first]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        kept = rank < give[w]
        tag = (band[w] << 40 | block).astype(np.uint64)
        out.append(mix(word + mix(tag))[kept])
        who.append(w[kept])
        # a set of n shingles fills more than 1.6 n / 2 of these blocks but for a chance below 10**-30; nothing may be lost by it
        if (has & (np.bincount(w, minlength=docs) < needed)).any():
            raise ArithmeticError("a document's shingles fill fewer blocks than it must give; change the hash of the blocks")
    return np.concatenate(out), np.concatenate(who)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(part: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, shingles, row of each from the first) of a batch, block by block."""
    data, offsets = utf8(part.column(column))
    for i, j in blocks(offsets, BLOCK):
        yield i, j - i, *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)


def _signatures(value: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each document's set. Equal sets have equal ones; different sets practically never do."""
    n = np.bincount(owner, minlength=docs)
    ends = np.cumsum(n)
    out = []
    for salt in (0x452821E638D01377, 0xBE5466CF34E90C6C):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))])
        out.append(mix((sums[ends] - sums[ends - n]) + n.astype(np.uint64)))
    return out[0], out[1]


def classes(docs: DataFrame, key: str, text: str, k: int = WORDS) -> DataFrame:
    """(key, n_shingles, s1, s2, f0 ... f7): documents with equal sets have equal s1 and s2; the words f are a sketch of
    FOLDED bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m, value, owner in _sets(batch, 1, k):
                s1, s2 = _signatures(value, owner, m)
                n = np.bincount(owner, minlength=m).astype(np.int64)
                words = (pa.array(w) for w in folded(value, owner, m))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, m), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), *words], names=[key, "n_shingles", "s1", "s2", *FLIPS])

    words = ", ".join(f"{f} bigint" for f in FLIPS)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_shingles bigint, s1 bigint, s2 bigint, {words}")


def buckets(docs: DataFrame, text: str, k: int = WORDS) -> DataFrame:
    """(bucket, s1): classes that share a join key with another class.

    A task gives the keys of a class once, however many copies it reads. Buckets are read in order, so that a frequent
    one needs no memory.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each class, with all its keys."""
        given: set[int] = set()
        for batch in batches:
            for _, m, value, owner in _sets(batch, 0, k):
                s1, _ = _signatures(value, owner, m)
                fresh = np.zeros(m, bool)
                for d, s in enumerate(s1.tolist()):
                    if s not in given:
                        given.add(s)
                        fresh[d] = True
                if len(given) > 1 << 20:
                    given.clear()
                mine = fresh[owner]
                key, who = keys(value[mine], owner[mine], m)
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=m))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(key)[np.argsort(who, kind="stable")]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(s1)), lists], names=["s1", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (bucket, s1), the buckets of at least two classes, once each class."""
        held = None  # the last row, whose bucket may go on, and whether it has been shown
        for batch in batches:
            b, s = (c.to_numpy() for c in batch.columns)
            if not len(b):
                continue
            if held is not None:
                b, s = np.append(held[0], b), np.append(held[1], s)
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
            b, s = b[new], s[new]
            first = np.ones(len(b), bool)
            first[1:] = b[1:] != b[:-1]
            at = np.flatnonzero(first)
            run = np.cumsum(first) - 1
            size = np.diff(np.append(at, len(b)))
            show = size[run] > 1
            going = held is not None and held[2]
            if going:  # the first bucket goes on from before
                show[run == 0] = True
                show[0] = False
            held = (b[-1:].copy(), s[-1:].copy(), bool(size[-1] > 1 or going and run[-1] == 0))
            if show.any():
                yield pa.RecordBatch.from_arrays([pa.array(b[show]), pa.array(s[show])], names=["bucket", "s1"])

    given = docs.select(text).mapInArrow(give, "s1 bigint, keys array<bigint>").select(F.explode("keys").alias("bucket"), "s1")
    dealt = given.repartition(partitions_for(docs), "bucket").sortWithinPartitions("bucket", "s1")
    return dealt.mapInArrow(meet, "bucket bigint, s1 bigint")


def folded(value: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """The sketches of documents' shingles, folded to FOLDED bits: one row of int64 for each of FLIPS."""
    bit = (mix(value ^ FLIP) & np.uint64(FOLDED - 1)).astype(np.int64)
    flips = (np.bincount(owner * FOLDED + bit, minlength=docs * FOLDED) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(flips.reshape(docs, FOLDED), axis=1).view(np.int64).T)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit string of a power of two, at least SKETCH bits a shingle, in which every shingle flips one bit."""
    bits = max(64, 1 << int(SKETCH * len(shingles) - 1).bit_length()) if len(shingles) else 64
    flips = np.bincount((mix(shingles ^ FLIP) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded: at most the shingles in which their sets differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def sets(docs: DataFrame, text: str, k: int = WORDS) -> DataFrame:
    """(id, n, sketch, shingles array<long>) of every document; id is the first signature of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m, value, owner in _sets(batch, 0, k):
                s1, _ = _signatures(value, owner, m)
                n = np.bincount(owner, minlength=m)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flips = pa.array([sketch(value[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(s1)), pa.array(n.astype(np.int64)), flips, pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(value)))], names=["id", "n", "sketch", "shingles"])

    return docs.select(text).mapInArrow(run, "id bigint, n bigint, sketch binary, shingles array<bigint>")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n, m, sketch of a, sketch of b) those whose sketches are not too far apart for their sizes."""
    for batch in batches:
        most = allowed(batch.column(2).to_numpy(), batch.column(3).to_numpy())
        near = [distance(x.as_py(), y.as_py()) <= d for x, y, d in zip(batch.column(4), batch.column(5), most)]
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def linked(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets `of` (id, n, sketch, shingles) are similar enough."""
    side = lambda x, *c: of.select(F.col("id").alias(x), *(F.col(y).alias(f"{y}_{x}") for y in c))
    close = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    kind = pairs.schema["a"].dataType.simpleString()
    close = staged(close.mapInArrow(_near, f"a {kind}, b {kind}"), "close")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    near = BELOW * both >= TOP * (F.col("n_a") + F.col("n_b") - both)
    out = staged(close.join(side("a", "n", "shingles"), "a").join(side("b", "n", "shingles"), "b").where(near).select("a", "b"), "links")
    discarded(close)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the smallest id that can be reached. Labels run along links and jump to
    their label's label, until none changes; the table of a round is written, so lineage stays short."""
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("then"))
        step = step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("then", "component")).alias("component"), "was")
        step = staged(step, "labels")
        changed = step.where("component <> was").limit(1).count()
        labels = step.drop("was")
        if not changed:
            return labels


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id) of every document: the size of its set of distinct shingles of k words, and the
    smallest key in its component of linked documents (itself, if it has no words: such documents link with nothing).

    Null texts count as empty. Documents with equal sets are one class, which its signature names; rows that repeat a key
    are rows of their own, whatever their texts. A null key is no smallest key unless its component has no other.
    """
    every = staged(classes(docs, key, text, k), "classes")
    one = every.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min(key).alias("least"), *(F.min(f).alias(f) for f in FLIPS))
    one = staged(one.withColumn("id", F.col("s1")), "class_ids")
    sized = one.select("s1", "id", F.col("n_shingles").alias("n"))
    # whoever shares fewer keys with all others together than it must share with one has no links
    shares = F.count(F.lit(1)).over(Window.partitionBy("s1"))
    named = buckets(docs, text, k).join(sized, "s1").withColumn("m", shares).where(F.col("m") >= surely(F.col("n"), False)).select("bucket", "id", "n", "m")
    named = staged(named, "named_buckets")
    released(docs.sparkSession)
    tested: list[DataFrame] = []
    links: list[DataFrame] = []

    def pairs(rows: DataFrame, counted: bool) -> DataFrame:
        """(a, b) of rows (x, nx, y, ny), one a shared key; if all shared keys are there, of those that share enough."""
        ordered = rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "nx", "ny")
        if not counted:
            return ordered.select("a", "b").distinct()
        each = ordered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
        return each.where(F.col("k") >= required(F.col("nx"), F.col("ny"))).select("a", "b")

    def test(candidates: DataFrame) -> DataFrame:
        """Checks those candidates that have not been; returns the components of all links so far."""
        for t in tested:
            candidates = candidates.join(t, ["a", "b"], "left_anti")
        fresh = staged(candidates, "pairs")
        tested.append(fresh)
        ids = staged(fresh.select(F.col("a").alias("id")).union(fresh.select("b")).distinct().join(one.select("id", "least"), "id"), "ids")
        few = ids.count() <= SMALL
        keys_ = ids.select(F.col("least").alias("__least")).distinct()
        met = F.col(key).eqNullSafe(F.col("__least"))
        # a key with several texts brings them all; those of other classes go again
        wanted = docs.select(key, text).join(F.broadcast(keys_) if few else keys_, met, "left_semi")
        found = sets(wanted, text, k).join(F.broadcast(ids.select("id")) if few else ids.select("id"), "id", "left_semi")
        of = staged(found.dropDuplicates(["id"]), "sets")
        links.append(linked(fresh, of))
        discarded(ids, of)
        released(docs.sparkSession)
        return components(reduce(DataFrame.union, links))

    def split(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Of rows (bucket, id, n) the buckets with several components, with each member's component."""
        with_label = rows.select("bucket", "id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = with_label.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
        return staged(with_label.join(several.select("bucket", "size"), "bucket").select("bucket", "id", "n", "component", "size"), "split")

    def with_hub(rows: DataFrame, order) -> DataFrame:
        """(x, nx, y, ny): each member of a bucket with the bucket's last one by `order`."""
        hub = rows.groupBy("bucket").agg(F.max_by(F.struct("id", "n"), order).alias("hub")).select("bucket", F.col("hub.id").alias("y"), F.col("hub.n").alias("ny"))
        return rows.select("bucket", F.col("id").alias("x"), F.col("n").alias("nx")).join(hub, "bucket")

    # these two find most links with few checks; what they leave out, the last step finds
    labels = test(pairs(with_hub(named, F.struct(F.col("m") / F.col("n"), "id")), True))
    rest = split(named, labels)
    discarded(named)
    labels = test(pairs(with_hub(rest, -F.xxhash64("bucket", "id")), True))
    rest, before = split(rest, labels), rest
    discarded(before)
    # two linked documents' first common key is among all but one less than their common keys, for both
    own = Window.partitionBy("id")
    ranked = rest.withColumn("k", F.row_number().over(own.orderBy("size", "bucket"))).withColumn("m", F.count(F.lit(1)).over(own))
    ranked = ranked.where(F.col("k") <= F.col("m") - surely(F.col("n"), False) + 1).join(one.select("id", *FLIPS), "id")
    ranked = staged(ranked, "first_keys")
    discarded(rest)
    small = ranked.where(F.col("k") <= F.col("m") - surely(F.col("n"), True) + 1)
    x = small.select("bucket", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), *FLIPS)
    y = ranked.select(F.col("bucket").alias("by"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), *(F.col(f).alias(f"{f}y") for f in FLIPS))
    in_order = F.struct("nx", "x") < F.struct("ny", "y")
    most = F.floor((F.col("nx") + F.col("ny")) * (BELOW - TOP) / (BELOW + TOP))
    near = reduce(lambda p, q: p + q, [F.bit_count(F.col(f).bitwiseXOR(F.col(f"{f}y"))) for f in FLIPS]) <= most
    across = x.join(y, (F.col("bucket") == F.col("by")) & (F.col("cx") != F.col("cy")) & (BELOW * F.col("nx") >= TOP * F.col("ny")) & in_order & near)
    labels = test(pairs(across, False))
    discarded(ranked, *tested, *links)
    released(docs.sparkSession)
    labelled = one.join(labels, "id", "left").select("n_shingles", "s1", "s2", "least", F.coalesce("component", "id").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("__component"))
    mapped = labelled.join(smallest, "label").select("n_shingles", "s1", "s2", "__component")
    return every.join(mapped, ["n_shingles", "s1", "s2"], "left").select(key, "n_shingles", F.coalesce("__component", key).alias("component_id"))


def op5(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
