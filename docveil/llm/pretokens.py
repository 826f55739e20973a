"""Pre-token splitting with the standard `re` module where it provably agrees with Unicode property classes."""

from __future__ import annotations

import re

import regex

#: Code points that the quick path may meet; any text with another one takes the exact path.
LIMIT = 0x2100


def _odd_characters() -> str:
    """Below LIMIT: those that `re` and the property classes put into different kinds, and those whose lower case or
    normal form depends on their surroundings."""
    letter, number, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\p{White_Space}")
    mark = regex.compile(r"\p{M}")
    out = []
    for c in map(chr, range(LIMIT)):
        kinds = [bool(letter.match(c)), bool(number.match(c)), bool(space.match(c))]
        quick = [bool(re.match(r"[^\W\d_]", c)), bool(re.match(r"\d", c)), bool(re.match(r"\s", c))]
        if kinds != quick or mark.match(c) or c in "Σİ" or bool(regex.match(r"\s", c)) != kinds[2]:
            out.append(c)
    return "".join(map(re.escape, out))


#: Finds the first character that needs the exact path.
ODD = re.compile(f"[{_odd_characters()}{chr(LIMIT)}-\U0010ffff]")


class Memo:
    """A table of at most twice `size` entries in two generations; what is used goes on to the younger one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of keys that must be computed; the others are in `young` afterwards."""
        young, old = self.young, self.old
        if len(young) > self.size:
            self.young, self.old = {}, young
            young, old = self.young, young
        out = []
        for k in keys.difference(young):
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                young[k] = v
        return out
