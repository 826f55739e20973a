"""External induced sorting of suffixes, with the lengths of their common prefixes up to a depth.

Only suffixes at local minima are sorted, by names: what lies between minima is named by its rank, and the string of names is
sorted by naming pairs of names, level by level, from tuples dealt by range to disk. All others follow by induction: read in
order, every suffix in place puts the one a character longer at the end of its bucket, first those that descend and then,
from the back, those that ascend. The buckets are a priority queue by first character whose entries, place and common prefix
with the entry before, move to disk once there are too many; within a bucket the order of insertion is the order of suffixes.
An entry's common prefix is one more than the least common prefix of the suffixes between the two that induced it and the
entry before. Text, types and names beyond a part are files of the task's attempt, read part by part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries of all buckets that stay in memory.
MEMORY = 1 << 22
#: Entries of a bucket that are read together, about.
AT_ONCE = 1 << 19
#: Suffixes at minima that are compared at once.
COMPARED = 1 << 16
#: Characters, samples or names that are worked on at once; beyond, they are on disk.
PART = 1 << 21
#: Characters of a piece, and lists into which many keys are dealt by range, at most.
PIECE, MOST_LISTS = 6, 512
NONE = 32000


class Buckets:
    """First-in first-out lists of (place, common prefix) by character; the entries move to disk beyond MEMORY."""

    def __init__(self, memory: int | None = None):
        self.memory = MEMORY if memory is None else memory
        self.parts: list[list] = [[] for _ in range(256)]
        self.held, self.file = 0, None

    def push(self, char: int, place: np.ndarray, common: np.ndarray) -> None:
        if not len(place):
            return
        self.parts[char].append((place, common))
        self.held += len(place)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """Unnamed scratch of one attempt of one task: it goes with the task, and a new attempt makes its own."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, p in enumerate(parts):
                if isinstance(p[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(p[0].astype("<i8").tobytes() + p[1].astype("<i2").tobytes())
                    parts[i] = (at, len(p[0]))
        self.held = 0

    def _load(self, p: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(p[0], np.ndarray):
            return p
        self.file.seek(p[0])
        return np.frombuffer(self.file.read(8 * p[1]), "<i8"), np.frombuffer(self.file.read(2 * p[1]), "<i2")

    def _joined(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        loaded = [self._load(p) for p in parts]
        return loaded[0] if len(loaded) == 1 else tuple(np.concatenate(c) for c in zip(*loaded))

    def pop(self, char: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bucket's entries, in order, about AT_ONCE together, with those that come in meanwhile; it is empty then."""
        while self.parts[char]:
            parts, size = self.parts[char], 0
            for k, p in enumerate(parts):
                size += len(p[0]) if isinstance(p[0], np.ndarray) else p[1]
                if size >= AT_ONCE:
                    break
            taken, self.parts[char] = parts[: k + 1], parts[k + 1 :]
            self.held -= sum(len(p[0]) for p in taken if isinstance(p[0], np.ndarray))
            yield self._joined(taken)

    def read(self, char: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in reversed(self.parts[char]) if backwards else list(self.parts[char]):
            yield self._load(p)


def scratch(kind: str, size: int, most: int) -> np.ndarray:
    """An array of zeros; of more than `most` bytes, it lies in an unnamed file of this attempt of the task."""
    if size * np.dtype(kind).itemsize <= most:
        return np.zeros(size, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(size,))


def ascending(text: np.ndarray, most: int = PART) -> np.ndarray:
    """Whether each suffix is less than the next one (S-type). The last one is not. Read in parts, from the back."""
    n = len(text)
    out = scratch("?", n, 8 * most)
    following = False  # the type of the suffix after the part
    for lo in range((max(n - 2, 0)) // most * most, -1, -most):
        hi = min(lo + most, n - 1)
        if hi <= lo:
            continue
        here, after = np.asarray(text[lo:hi]), np.asarray(text[lo + 1 : hi + 1])
        part, same = after > here, after == here
        # equal characters have the type of the next place at which they differ
        at = np.where(same, hi - lo, np.arange(hi - lo))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[lo:hi] = np.append(part, following)[at]
        following = bool(out[lo])
    return out


def run(text: np.ndarray, at: int, most: int) -> int:
    """How many characters from there on are equal, at most `most`."""
    part = np.asarray(text[at : at + most])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def samples(text: np.ndarray, rises: np.ndarray, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Local minima, and after each every PIECE-th place up to the next one, in parts: places, and whether they are minima.
    What is sampled after a minimum depends on what follows it alone."""
    last = None  # the last minimum so far
    for lo in range(0, max(len(text), 1), most):
        hi = min(lo + most, len(text))
        types = np.asarray(rises[max(lo - 1, 0) : hi])
        found = np.flatnonzero(types[1:] & ~types[:-1]) + max(lo - 1, 0) + 1
        places = found if last is None else np.append(last, found)
        if len(places) > 1:
            steps = -(-np.diff(places) // PIECE)
            first = np.repeat(np.cumsum(steps) - steps, steps)
            yield np.repeat(places[:-1], steps) + (np.arange(len(first)) - first) * PIECE, np.arange(len(first)) == first
        last = int(places[-1]) if len(places) else None
    if last is not None:
        rest = np.arange(last, len(text), PIECE)
        yield rest, rest == last


def ranks(keys: np.ndarray, most: int = PART) -> tuple[np.ndarray, int]:
    """The dense rank, from 1, of each key among all, and how many there are. More than `most` keys are dealt by range into
    lists on disk, which are sorted one by one; a key that is frequent has a list of its own, which needs no sorting."""
    n = len(keys)
    if n <= most:
        values, at = np.unique(keys, return_inverse=True)
        return at.astype(np.int32) + 1, len(values)
    step = max(1, most // 64)
    cuts = np.unique(np.concatenate([np.asarray(keys[i : i + most])[::step] for i in range(0, n, most)]))
    cuts = cuts[:: max(1, len(cuts) // MOST_LISTS)]
    lists = Lists(2 * len(cuts) + 1, ("<u8", "<i8"), most)
    for lo in range(0, n, most):
        part = np.asarray(keys[lo : lo + most])
        below = np.searchsorted(cuts, part, "left")
        equal = (below < len(cuts)) & (cuts[np.minimum(below, len(cuts) - 1)] == part)
        lists.deal(2 * below + equal, part, np.arange(lo, lo + len(part)))
    out, count = scratch("<i4", n, 8 * most), 0
    for k in range(2 * len(cuts) + 1):
        if k % 2:
            for _, index in lists.read(k):
                out[index] = count + 1
            count += lists.sizes[k] > 0
        elif lists.sizes[k]:
            key, index = (np.concatenate(c) for c in zip(*lists.read(k)))
            values, at = np.unique(key, return_inverse=True)
            out[index] = count + 1 + at
            count += len(values)
    return out, int(count)


class Lists:
    """Numbered lists of tuples, appended to in any order and read back one by one; beyond `most` tuples they are on disk."""

    def __init__(self, count: int, kinds: tuple[str, ...], most: int):
        self.kinds, self.most, self.held, self.file = kinds, most, 0, None
        self.parts: list[list] = [[] for _ in range(count)]
        self.sizes = [0] * count

    def deal(self, number: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(number, kind="stable")
        number = number[order]
        at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else number
        for a, b in zip(at, np.append(at[1:], len(number))):
            self.parts[int(number[a])].append(tuple(c[order[a:b]].astype(k) for c, k in zip(columns, self.kinds)))
            self.sizes[int(number[a])] += int(b - a)
        self.held += len(number)
        if self.held > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for parts in self.parts:
                for i, p in enumerate(parts):
                    if isinstance(p[0], np.ndarray):
                        parts[i] = (self.file.tell(), len(p[0]))
                        self.file.write(b"".join(c.tobytes() for c in p))
            self.held = 0

    def read(self, number: int) -> Iterator[tuple[np.ndarray, ...]]:
        for p in self.parts[number]:
            if isinstance(p[0], np.ndarray):
                yield p
            else:
                self.file.seek(p[0])
                yield tuple(np.frombuffer(self.file.read(p[1] * np.dtype(k).itemsize), k) for k in self.kinds)


def pieces(text: np.ndarray, rises: np.ndarray, at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The characters from each sample to the next one, itself included, with their types, in 63 bits. Of equal characters a
    falling suffix is less; so a piece is never the beginning of another one, but at the end of the text."""
    out = np.zeros(len(at), np.uint64)
    for k in range(PIECE + 1):
        where = at + k
        ok = (where <= following) & (where < len(text))
        where = np.where(ok, where, 0)
        code = np.where(ok, text[where].astype(np.uint64) * np.uint64(2) + rises[where], 0)
        out = out << np.uint64(9) | code.astype(np.uint64)
    return out


def minima(text: np.ndarray, rises: np.ndarray, depth: int, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes at local minima in order of their first `depth` characters, and their common prefixes up to it, in parts.

    Samples are named by the rank of their piece, then, level by level, by the rank of their name and that of the sample as
    many on as the name spans, until every name spans `depth` characters.
    """
    count = sum(len(p) for p, _ in samples(text, rises, most))
    if not count:
        return
    places, seeds, at = scratch("<i8", count, 8 * most), scratch("?", count, 8 * most), 0
    for p, m in samples(text, rises, most):
        places[at : at + len(p)], seeds[at : at + len(p)] = p, m
        at += len(p)
    keys = scratch("<u8", count, 8 * most)
    for lo in range(0, count, most):
        hi = min(lo + most, count)
        following = np.append(places[lo + 1 : hi], places[hi] if hi < count else len(text))
        keys[lo:hi] = pieces(text, rises, np.asarray(places[lo:hi]), following)
    names, different = ranks(keys, most)
    span = 1
    while different < count and not _spans(places, span, depth, most):
        for lo in range(0, count, most):
            hi = min(lo + most, count)
            after = np.zeros(hi - lo, np.uint64)
            known = names[lo + span : min(hi + span, count)]
            after[: len(known)] = known
            keys[lo:hi] = np.asarray(names[lo:hi]).astype(np.uint64) << np.uint64(32) | after
        names, different = ranks(keys, most)
        span *= 2
    del keys
    # in order of names: dealt by range, each range sorted
    share = max(1, -(-different // max(1, count // max(1, most // 2) + 1)))
    lists = Lists(different // share + 1, ("<i4", "<i8"), most)
    for lo in range(0, count, most):
        seed = np.flatnonzero(seeds[lo : lo + most])
        name = np.asarray(names[lo : lo + most])[seed]
        lists.deal(name // share, name, np.asarray(places[lo : lo + most])[seed])
    before = None
    for k in range(len(lists.parts)):
        if lists.sizes[k]:
            if share == 1:
                sorted_ = (where for _, where in lists.read(k))
            else:
                name, where = (np.concatenate(c) for c in zip(*lists.read(k)))
                sorted_ = iter([where[np.argsort(name, kind="stable")]])
            for where in sorted_:
                for lo in range(0, len(where), COMPARED):
                    part = where[lo : lo + COMPARED]
                    yield part, commons(text, part, before, depth)
                    before = int(part[-1])


def _spans(places: np.ndarray, span: int, depth: int, most: int) -> bool:
    """Whether `span` samples always are at least `depth` characters, or all up to the end."""
    for lo in range(0, len(places) - span, most):
        hi = min(lo + most, len(places) - span)
        if (np.asarray(places[lo + span : hi + span]) - places[lo:hi]).min() < depth:
            return False
    return True


def commons(text: np.ndarray, places: np.ndarray, before: int | None, depth: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it, up to depth; 0 for the first of all."""
    left = places if before is None else np.append(before, places)
    out = np.zeros(len(left) - 1, np.int16)
    width = -(-depth // 8) * 8
    inside = np.maximum(left[1:], left[:-1]) + width <= len(text)
    at = np.flatnonzero(inside)
    if len(at):  # eight characters at once, from any place
        words = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
        rows = words[np.minimum(left, len(text) - width)[:, None] + np.arange(0, width, 8)]
        apart = rows[1:] ^ rows[:-1]
        word = (apart != 0).argmax(axis=1)
        low = apart[np.arange(len(apart)), word]
        low &= -low
        same = word * 8 + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        out[at] = np.where(low == 0, depth, np.minimum(same, depth))[at]
    for i in np.flatnonzero(~inside).tolist():
        a, b = (np.asarray(text[left[k] : left[k] + depth]) for k in (i, i + 1))
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        out[i] = differ[0] if len(differ) else n
    return np.append(np.zeros(1, np.int16), out) if before is None else out


class _Least:
    """Range minima of one list, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels, d = [values], 1
        while 2 * d <= len(values):
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-d], top[d:]))
            d *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima from lo to before hi (lo < hi)."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << int(k))])
        return out


class _Pass:
    """One direction of induction: puts the suffix before each one given into its bucket, if it is of the wanted type."""

    def __init__(self, text: np.ndarray, rises: np.ndarray, wanted: bool, depth: int, queue: Buckets):
        self.text, self.rises, self.wanted, self.depth, self.queue = text, rises, wanted, depth, queue
        self.since = np.full(256, -1, np.int16)  # least common prefix since the last entry of a bucket; -1 before the first

    def give(self, place: np.ndarray, common: np.ndarray) -> None:
        m = len(place)
        if not m:
            return
        before = np.maximum(place - 1, 0)
        at = np.flatnonzero((place > 0) & (self.rises[before] == self.wanted))
        least_of_all = common.min()
        if len(at):
            where = before[at]
            chars = self.text[where]
            order = np.argsort(chars, kind="stable")
            at, where, chars = at[order], where[order], chars[order]
            first = np.ones(len(at), bool)
            first[1:] = chars[1:] != chars[:-1]
            lo = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
            table = _Least(common)
            least = table(lo, at + 1)
            least[first] = np.minimum(least[first], self.since[chars[first]])
            grown = np.minimum(least + 1, self.depth).astype(np.int16)
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(at))
            self.since = np.minimum(self.since, least_of_all)
            last = at[ends - 1] + 1
            rest = np.full(len(last), NONE, np.int16)
            some = last < m
            if some.any():
                rest[some] = table(last[some], np.full(int(some.sum()), m))
            self.since[chars[starts]] = rest
            for a, b, c in zip(starts.tolist(), ends.tolist(), chars[starts].tolist()):
                self.queue.push(c, where[a:b], grown[a:b])
        else:
            self.since = np.minimum(self.since, least_of_all)


def suffixes(text: np.ndarray, depth: int, memory: int | None = None, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text in order of their first `depth` characters, in parts: places, and how much each has in common
    with the one before it, up to depth. Suffixes equal to that depth stand together in any order. No character is 255
    but at the end of what may match."""
    rises = ascending(text, most)
    seeds = Buckets(memory)
    for place, common in minima(text, rises, depth, most):
        chars = np.asarray(text[place])
        at = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        for a, b in zip(at, np.append(at[1:], len(place))):
            seeds.push(int(chars[a]), place[a:b], common[a:b])
    falling, done = Buckets(memory), Buckets(memory)
    down = _Pass(text, rises, False, depth, falling)
    end = len(text) - 1
    if end >= 0:  # the shortest suffix has nothing after it to induce it
        falling.push(int(text[end]), np.array([end]), np.zeros(1, np.int16))
        down.since[int(text[end])] = 0
    for c in range(256):
        tail = None
        for place, common in falling.pop(c):
            done.push(c, place, common)
            down.give(place, common)
            tail = int(place[-1])
        first = True
        for place, common in seeds.pop(c):
            if first:
                common = common.copy()
                common[0] = min(run(text, tail, depth), run(text, int(place[0]), depth)) if tail is not None else 0
                first = False
            down.give(place, common)
    rising, raised = Buckets(memory), Buckets(memory)
    up = _Pass(text, rises, True, depth, rising)
    for c in range(255, -1, -1):
        tail = None
        for place, common in rising.pop(c):
            raised.push(c, place, common)
            up.give(place, common)
            tail = int(place[-1])
        following = None  # common prefix of the last one given with the one before it in order
        for place, common in done.read(c, backwards=True):
            back = np.empty(len(place), np.int16)
            back[1:] = common[:0:-1]
            if following is not None:
                back[0] = following
            else:
                back[0] = min(run(text, tail, depth), run(text, int(place[-1]), depth)) if tail is not None else 0
            up.give(place[::-1], back)
            following = int(common[0])
    for c in range(256):
        tail = None
        for place, common in done.read(c):
            yield place, common
            tail = int(place[-1])
        # ascending suffixes were found from the last to the first, each with the one after it
        following = None
        for place, common in raised.read(c, backwards=True):
            ahead = np.empty(len(place), np.int16)
            ahead[1:] = common[:0:-1]
            if following is not None:
                ahead[0] = following
            else:
                ahead[0] = min(run(text, tail, depth), run(text, int(place[-1]), depth)) if tail is not None else 0
            yield place[::-1], ahead
            following = int(common[0])
