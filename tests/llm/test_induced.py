import random

import numpy as np
import pytest

from docveil.llm import induced


def common(a, b, depth):
    n = 0
    while n < min(len(a), len(b), depth) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("memory, most", [(None, 1 << 20), (5, 1 << 20), (5, 7), (None, 64)])
def test_against_sorting(seed, memory, most, monkeypatch):
    monkeypatch.setattr(induced, "COMPARED", 3)
    monkeypatch.setattr(induced, "MOST_LISTS", 3)
    rng = random.Random(seed)
    depth = rng.choice([3, 8, 20])
    letters = rng.choice([b"ab", b"a", b"abc", bytes(range(200))])
    parts = []
    for _ in range(rng.randint(0, 8)):
        part = bytes(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        parts += [part, part[rng.randint(0, len(part)) :]]
    text = b"".join(p + b"\xff" for p in parts)
    data = np.frombuffer(text, np.uint8)
    got = list(induced.suffixes(data, depth, memory, most))
    places = [int(p) for part, _ in got for p in part]
    shared = [int(c) for _, part in got for c in part]
    assert sorted(places) == list(range(len(text)))
    cut = [text[p : p + depth] for p in places]
    # what ends with the text is only in place up to its end
    assert all(a <= b or a.startswith(b) for a, b in zip(cut, cut[1:]))
    for i in range(1, len(places)):
        assert shared[i] == common(cut[i], cut[i - 1], depth), (text, places, shared)


BOUNDED = """
import tempfile
import numpy as np
from docveil.llm import induced
rng = np.random.default_rng(1)
file = tempfile.TemporaryFile()
line = rng.integers(97, 110, 140, dtype=np.uint8)
for k in range(size // 141):  # a third of all lines are one line
    file.write((line if k % 3 == 0 else rng.integers(97, 110, 140, dtype=np.uint8)).tobytes() + bytes([255]))
file.flush()
text = np.memmap(file, np.uint8, "r")
anonymous = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon"))
before = anonymous()
peak = n = 0
for place, common in induced.suffixes(text, 100, 1 << 16, 1 << 16):
    for i in np.random.default_rng(n).integers(0, len(place) - 1, 3) if len(place) > 1 else []:
        a, b = bytes(text[place[i] : place[i] + 100]), bytes(text[place[i + 1] : place[i + 1] + 100])
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert same == min(100, common[i + 1]) and (a <= b or len(b) < 100)
    n += len(place)
    peak = max(peak, anonymous() - before)
assert n == len(text)
print(peak)
"""


def test_a_shard_far_larger_than_memory():
    """A shard of 300 times the entries that stay in memory: what is not in files stays small, and does not grow with it."""
    import subprocess
    import sys
    from pathlib import Path

    peaks = []
    for size in (1_000_000, 6_000_000):
        run = subprocess.run([sys.executable, "-c", f"size = {size}\n{BOUNDED}"], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=600)
        assert run.returncode == 0, run.stderr
        peaks.append(int(run.stdout))
    assert peaks[1] < 50_000 and peaks[1] < 2 * peaks[0] + 10_000  # kB in memory that are not pages of files
