"""Phrase collocations, mined by position bitmaps.

Texts of a language are laid end to end in shards. A shard's words are numbered by position, with a gap between pieces, and
each word has a bitmap of its positions: only containers of 16 positions in which the word is, by number. A phrase's bitmap
says where its last word is. Shifted by one position and ANDed with a word's bitmap, container by container, it is the
bitmap of the phrase that goes on with this word; its set bits are counted. No bit crosses a gap, as no word is there. Runs of
phrase beginnings go to full length one after another, depth first, so that memory does not grow with the shard. Counts are
summed over the shards.

What is frequent is known only of the corpus, not of a shard. So hashes of words and pairs are counted first, then those of
longer phrases, size by size, of frequent parts only; what is frequent sets bits in an array of fixed size. At last, words and
phrases with their bits set are counted by their text; one let through by chance is found infrequent there. Hashes go to their
sums as sorted runs, a row for each bucket of a task, which other tasks merge bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docveil.llm.common import mix, partitions_for, staged, table, utf8

#: Bytes of text of a shard; a longer piece is not cut.
SHARD = 1 << 23
#: Bits of a container, and positions in which the phrases begin that are extended together.
WIDTH = 16
STARTS = 1 << 16
#: Size of the bit array of frequent phrases.
FILTER_BITS = 1 << 25
#: Hashes are summed by at most so many buckets, one at a time in a task.
BUCKETS = 1 << 18
#: Hashes a task sums before it sends them on.
HELD = 1 << 21
#: Rows that leave a task at once.
ROWS = 1 << 16
#: A key that many candidates share is dealt to so many tasks.
SALTS = 64

SPACE, BREAK = 32, 10
COUNTS = "lang string, size int, phrase string, n bigint"


def _kinds() -> np.ndarray:
    """Bytes as they count: A-Z in lower case, tabs as spaces, ends of pieces as line feeds."""
    kinds = np.arange(256, dtype=np.uint8)
    kinds[ord("A") : ord("Z") + 1] += 32
    kinds[9] = SPACE
    kinds[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
    return kinds


class Shard:
    """Words of some text, by number and position."""

    def __init__(self, lang: str, text: np.ndarray) -> None:
        self.lang = lang
        inside = (text != SPACE) & (text != BREAK)
        begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        self.n = len(begins)
        lengths = np.add.reduceat(inside, begins, dtype=np.int64) if self.n else begins
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])]).dictionary_encode()
        self.words, ids = words.dictionary, words.indices.to_numpy()
        piece = np.cumsum(text == BREAK)[begins] if self.n else begins
        self.at = np.arange(self.n) + np.cumsum(np.concatenate([[0], np.diff(piece) > 0])) if self.n else begins
        self.seen = np.bincount(ids, minlength=len(self.words))
        # the bitmaps of all words: containers by number, in each the words that are in it
        spread = len(self.words) + 1
        key = self.at // WIDTH * spread + ids
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if self.n else order
        bit = (1 << (self.at % WIDTH)).astype(np.uint16)[order]
        self.container, self.word = key[first] // spread, key[first] % spread
        self.bits = np.bitwise_or.reduceat(bit, first) if self.n else bit
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = word_hashes(self.words)
        return self._hashes

    def extended(self, container: np.ndarray, prefix: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shift and AND: of the bitmaps of prefixes, the non-empty ones with one more word: container, prefix, word, bits."""
        moved = bits.astype(np.uint32) << 1
        low, carry = (moved & 0xFFFF).astype(np.uint16), np.flatnonzero(moved >> WIDTH)
        some = np.flatnonzero(low)
        container = np.concatenate([container[some], container[carry] + 1])
        prefix = np.concatenate([prefix[some], prefix[carry]])
        bits = np.concatenate([low[some], np.ones(len(carry), np.uint16)])
        begin, end = np.searchsorted(self.container, container, "left"), np.searchsorted(self.container, container, "right")
        many = end - begin
        mine = np.repeat(np.arange(len(container)), many)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        both = bits[mine] & self.bits[other]
        hit = np.flatnonzero(both)
        return container[mine[hit]], prefix[mine[hit]], self.word[other[hit]], both[hit]

    def extensions(self, most: int, seen: np.ndarray | None, whole: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, phrases, counts) of 2 to `most` words, for one run of beginnings after another; a phrase is a row of word
        numbers. With `seen`, only phrases that may be frequent go on; of those of `most` words, that is asked of their last
        most - 1 words if `whole` is not set."""
        last = int(self.at[-1]) + 1 if self.n else 0
        for lo in range(0, last, STARTS):
            i, j = np.searchsorted(self.container, [lo // WIDTH, (lo + STARTS) // WIDTH])
            words, prefix = np.unique(self.word[i:j], return_inverse=True)
            rows, container, bits = words[:, None], self.container[i:j], self.bits[i:j]
            for size in range(2, most + 1):
                container, prefix, word, bits = self.extended(container, prefix, bits)
                longer, prefix = np.unique(prefix * len(self.words) + word, return_inverse=True)
                rows = np.concatenate([rows[longer // len(self.words)], (longer % len(self.words))[:, None]], axis=1)
                if seen is not None:
                    fine = may_be_in(seen, phrase_hashes(self.lang, self.hashes[rows if whole or size < most else rows[:, 1:]]))
                    stay, number = fine[prefix], np.cumsum(fine) - 1
                    container, prefix, bits, rows = container[stay], number[prefix[stay]], bits[stay], rows[fine]
                if not len(rows):
                    break
                yield size, rows, np.bincount(prefix, np.bitwise_count(bits), len(rows)).astype(np.int64)

    def phrases(self, most: int, seen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of each size and how often each is here."""
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, rows, n in self.extensions(most, seen):
            found.setdefault(size, []).append((rows, n))
        for size in sorted(found):
            rows, n = (np.concatenate(x) for x in zip(*found.pop(size)))
            order = np.lexsort(rows.T)
            rows, n = rows[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
            yield rows[first], np.add.reduceat(n, first)

    def hashed(self, size: int, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of all phrases of `size` words, and how often each is here; size 2 has the words as well."""
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if size == 2:
            hashes, counts = [phrase_hashes(self.lang, self.hashes[:, None])], [self.seen]
        for of, rows, n in self.extensions(size, seen, whole=False):
            if of == size:
                hashes.append(phrase_hashes(self.lang, self.hashes[rows]))
                counts.append(n)
        values, of = np.unique(np.concatenate(hashes), return_inverse=True)
        return values, np.bincount(of, np.concatenate(counts), len(values)).astype(np.int64)

    def told(self, rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            phrase = pc.binary_join_element_wise(*(self.words.take(pa.array(c)) for c in some.T), pa.scalar(b" ", pa.large_binary())) if some.shape[1] > 1 else self.words.take(pa.array(some[:, 0]))
            yield _rows(self.lang, some.shape[1], phrase.cast(pa.large_string()).cast(pa.string()), n[i : i + ROWS])


def _rows(lang: str, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)), phrase, pa.array(n)], names=["lang", "size", "phrase", "n"])


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)


def phrase_hashes(lang: str, hashes: np.ndarray) -> np.ndarray:
    """A hash of each phrase, given as a row of word hashes, with its language."""
    h = np.full(len(hashes), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for column in hashes.T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def may_be_in(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = bits_of(hashes)
    return (seen[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of about SHARD bytes of one language each, of batches of lang and text. Texts longer than that are cut between
    pieces."""
    kinds, gap = _kinds(), np.array([BREAK], np.uint8)
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> Shard:
        sizes.pop(lang)
        return Shard(lang, np.concatenate(held.pop(lang)))

    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = kinds[raw[offsets[i] : offsets[i + 1]]]
            while len(text):
                part = text
                if len(text) > SHARD:
                    back = np.flatnonzero(text[:SHARD] == BREAK)
                    ahead = back[-1:] if len(back) else np.flatnonzero(text[SHARD:] == BREAK)[:1] + SHARD
                    part = text[: ahead[0] + 1] if len(ahead) else text
                text = text[len(part) :]
                held.setdefault(lang, []).extend((part, gap))
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= SHARD:
                    yield out(lang)
            if sum(sizes.values()) > 4 * SHARD:
                yield out(max(sizes, key=sizes.get))
    for lang in list(held):
        yield out(lang)


def frequent_bits(docs: DataFrame, size: int, seen: np.ndarray | None, least: int) -> np.ndarray:
    """A bit array of FILTER_BITS, however many phrases there are, in which the bits are set of all phrases of `size` words
    that are there `least` times or more in docs (lang, text); of size 2, of all words too."""
    buckets = min(4 * partitions_for(docs), BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(seen) if seen is not None else None
    # what one task counts beyond `least` makes no difference
    count = np.min_scalar_type(least)

    def runs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        values, of = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        n = np.minimum(np.bincount(of, np.concatenate([n for _, n in held]), len(values)), least).astype(count)
        low = (values & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(low, kind="stable")
        low, high, n = low[order], (values[order] >> np.uint64(32)).astype(np.uint32), n[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        ends = np.concatenate([first, [len(low)]])
        blobs = [[x[i:j].tobytes() for i, j in zip(ends, ends[1:])] for x in (high, n)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(low[first].astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "high", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for shard in shards(batches):
            held.append(shard.hashed(size, shared.value if shared is not None else None))
            if sum(len(v) for v, _ in held) > HELD:
                yield runs(held)
        if held:
            yield runs(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, now, held = np.zeros(FILTER_BITS >> 6, np.uint64), None, []

        def close() -> None:
            high, n = (np.concatenate([np.frombuffer(x, kind) for x in part]) for part, kind in zip(zip(*held), (np.uint32, count)))
            values, of = np.unique(high, return_inverse=True)
            bit = bits_of(values[np.bincount(of, n, len(values)) >= least].astype(np.uint64) << np.uint64(32))
            np.bitwise_or.at(mine, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
            held.clear()

        for batch in batches:
            for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if held and bucket != now:
                    close()
                now = bucket
                held.append(blobs)
        if held:
            close()
        some = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(mine[some].view(np.int64))], names=["block", "bits"])

    dealt = docs.mapInArrow(run, "bucket int, high binary, n binary").repartition(partitions_for(docs), "bucket").sortWithinPartitions("bucket")
    got = dealt.mapInArrow(merged, "block int, bits bigint").groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[got["block"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out if seen is None else out | seen


def counted(docs: DataFrame, most: int, seen: np.ndarray) -> DataFrame:
    """lang, size, phrase, n of docs (lang, text): all words and phrases that may be frequent; as size 0, the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            yield _rows(shard.lang, 0, pa.array([""]), np.array([shard.n]))
            some = np.flatnonzero(may_be_in(shared.value, phrase_hashes(shard.lang, shard.hashes[:, None])))
            yield from shard.told(some[:, None], shard.seen[some])
            for rows, n in shard.phrases(most, shared.value):
                yield from shard.told(rows, n)

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _parts(words: Column, begin: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def not_within_longer(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases that lie in no longer one that is at least `share` per cent as frequent. Parts of a phrase are looked up by name."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _parts(words, i, m))))
    parts = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "n")
    longer = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n"))).drop("longer")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase by its weakest cut.

    A part that many phrases share is looked up once for each of SALTS groups of these, so its phrases do not meet in one task.
    """
    words, salt = F.split("phrase", " "), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    ends = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct((2 * k).alias("cut"), _parts(words, F.lit(1), k).alias("part")), F.struct((2 * k + 1).alias("cut"), _parts(words, k + 1, F.col("size")).alias("part"))))
    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), salt.alias("salt"), F.explode(F.flatten(ends)).alias("c")).select("*", "c.*").drop("c")
    wanted = cuts.select("lang", "part", "salt").distinct()
    found = wanted.join(counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    both = cuts.join(found, ["lang", "part", "salt"]).groupBy("lang", "phrase", "size", "a").agg(F.map_from_entries(F.collect_list(F.struct("cut", "f"))).alias("f"))
    # a has up to 16 digits: its square times a million is exact in 38
    score = "cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) * cast(1000000 as decimal(7, 0)) div (cast(f[2 * k] as decimal(18, 0)) * cast(f[2 * k + 1] as decimal(18, 0)))"
    weakest = F.expr(f"array_min(transform(sequence(1, size - 1), k -> struct({score} as score, k as k, f[2 * k] as l, f[2 * k + 1] as r)))")
    return both.select("lang", "phrase", "a", weakest.alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to max_words words of each language.

    Null texts are empty, null languages `und`; repeated rows count once more each; other columns are not looked at. Phrases
    with the same score and count come in the byte order of their text. A language without frequent phrases has no rows; an
    empty table has none. A text of any length is cut between pieces; a piece is held whole by one task. max_words is 2 to 16.
    """
    if not 2 <= max_words <= WIDTH:
        raise ValueError(f"max_words must be 2 to {WIDTH}")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    seen = None
    for size in range(2, max_words + 1):
        seen = frequent_bits(rows, size, seen, least)
    counts = counted(rows, max_words, seen)
    frequent = staged(counts.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")
    best = scored(not_within_longer(frequent.where("size > 1"), within), frequent)
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    # the first ones of parts of a language, then of parts of these, so that a task sees a few times `top` rows at most
    for parts in (16, 4):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        best = best.withColumn("i", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("i") <= top).drop("i")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sums = frequent.where("size = 0").select("lang", "n")
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, m AS size, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 4) s(m)),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
    c AS MATERIALIZED (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
    d AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
    k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM c, range(1, 3) s(k) WHERE k < size),
    s AS (SELECT k.lang, k.phrase, a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN d USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
    n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
