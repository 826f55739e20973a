"""Known values in texts, however they are written: one automaton over letters and digits for all values of a matter.

A text is normalised (case, marks, invisible characters), then all that is neither letter nor digit is left out. In what
remains, an automaton with failure links finds the letters and digits of every value in one pass. Only then is looked at what
stood between: each family of values says what may separate its characters, what may stand on either side, and what belongs
to it in front (the country of an IBAN, the prefix of a phone number).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick

from docveil.operators.vault import LABEL

#: Values of fewer letters, digits, or letters and digits in clusters are not looked for.
LETTERS, DIGITS, CLUSTERS = 3, 6, 4
#: Letters that Unicode does not take apart. Fixed values.
FOLD = {ord("ı"): "i", ord("İ"): "i", ord("I"): "i", ord("ə"): "e", ord("Ə"): "e"}
DASHES = "-‐‑‒–—―−"
SHOWN = re.compile(LABEL)


def _invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Mn", "Me", "Mc")


def _folded(c: str) -> str:
    return "".join(e for d in unicodedata.normalize("NFKD", c.translate(FOLD)) if not _invisible(d) for e in d.lower() if not _invisible(e))


#: What each character below U+0250 folds to, where that is one character; all others are folded one by one.
TABLE = {i: f for i in range(0x250) if not _invisible(chr(i)) and len(f := _folded(chr(i))) == 1}
OTHERS = re.compile("[^" + "".join(re.escape(chr(i)) for i in TABLE) + "]")


class Normalised:
    """A text's folded form, with places as runs: from each run's start, places in the text go on one by one (or stay, where
    one character became several)."""

    def __init__(self, text: str) -> None:
        self.starts, self.places, parts, at, n = [0], [0], [], 0, 0
        for m in OTHERS.finditer(text):
            i = m.start()
            parts.append(text[at:i].translate(TABLE))
            n += i - at
            for c in _folded(m[0]):
                self._run(n, i)
                parts.append(c)
                n += 1
            at = i + 1
            self._run(n, at)
        parts.append(text[at:].translate(TABLE))
        self.text = "".join(parts)

    def _run(self, start: int, place: int) -> None:
        if self.starts[-1] == start:
            self.places[-1] = place
        else:
            self.starts.append(start)
            self.places.append(place)

    def place(self, i: int) -> int:
        """Where the i-th character was."""
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]


RUN = re.compile(r"[^\W_]+")
BETWEEN = re.compile(r"[\W_]+")
#: A word broken over two lines.
BROKEN = re.compile(rf"[{DASHES}][ \t\r]*\n\s*")


class Compact:
    """Letters and digits of a normalised text, and what stood between them."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.places, self.gaps = "", [], [], {}
        parts, n, end = [], 0, 0
        for m in RUN.finditer(text):
            gap = text[end : m.start()]
            if n and not (BROKEN.fullmatch(gap) and text[end - 1].isalpha() and m[0][0].isalpha()):
                self.gaps[n] = gap
            self.starts.append(n)
            self.places.append(m.start())
            parts.append(m[0])
            n, end = n + len(m[0]), m.end()
        self.text = "".join(parts)

    def place(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]

    def before(self, i: int) -> str:
        """The character right before the i-th, with nothing between."""
        return self.text[i - 1] if i and i not in self.gaps else ""

    def after(self, i: int) -> str:
        return self.text[i] if i < len(self.text) and i not in self.gaps else ""


#: What may stand between two characters of a value.
NUMBER = re.compile(rf"[\s._/(){DASHES},]{{0,4}}")
CLUSTER = re.compile(rf"[\s._/(){DASHES},:;]{{0,4}}")
SPACED = re.compile(rf"[\s_{DASHES},]{{1,4}}")
HYPHEN = re.compile(rf"\s{{0,2}}[{DASHES}]?\s{{0,2}}")
INITIAL = re.compile(r"[.]\s{0,2}")
NOTHING = re.compile("")
#: What may not stand beside a value.
DIGIT, ALNUM, NEVER = str.isdigit, str.isalnum, lambda c: False
#: Digits in front of a national phone number. Fixed values.
PREFIXES = ("0090", "90", "0")


@dataclass(frozen=True)
class Form:
    """A value as looked for: its letters and digits, what may be before each of them but the first (all the same, or each its
    own), what may not be on either side, what goes with it in front, and whether it has to begin with a capital."""

    compact: str
    between: re.Pattern | tuple[re.Pattern, ...]
    left: object
    right: object
    front: tuple[str, ...] = ()
    capital: bool = False
    alone: bool = False  # no longer number goes on before or after it

    def span(self, c: Compact, end: int) -> tuple[int, int] | None:
        """Start and end in c's letters and digits, if the value is there."""
        start = end - len(self.compact)
        every = self.between if isinstance(self.between, tuple) else None
        for i in range(start + 1, end):
            gap = c.gaps.get(i)
            need = every[i - start - 1] if every else self.between
            if gap is None and need in (NOTHING, NUMBER, CLUSTER, HYPHEN):
                continue
            if need is NOTHING or not need.fullmatch(gap or ""):
                return None
        if self.right(c.after(end) or " "):
            return None
        for head in self.front:
            k = start - len(head)
            if k >= 0 and c.text[k:start] == head and all(NUMBER.fullmatch(c.gaps.get(i, "")) for i in range(k + 1, start + 1)) and not (head.isdigit() and c.before(k).isdigit()):
                return k, end
        if self.left(c.before(start) or " "):
            return None
        if self.alone and (re.fullmatch(r"[/.-]", c.gaps.get(start, "")) and c.text[start - 1].isdigit() or re.fullmatch(r"[/.-]", c.gaps.get(end, "")) and end < len(c.text) and c.text[end].isdigit()):
            return None
        return start, end


def national(digits: str, label_type: str) -> str:
    """The ten digits of a phone number at home; empty if it is none."""
    for head in PREFIXES:
        if digits.startswith(head) and len(digits) == len(head) + 10:
            digits, label_type = digits[len(head) :], "TELEFON"
            break
    return digits if label_type == "TELEFON" and len(digits) == 10 and digits[0] != "0" else ""


@lru_cache(100_000)
def forms_of(label_type: str, value: str) -> tuple[Form, ...]:
    """How a value is looked for; nothing if it is too short to tell."""
    plain = Normalised(value).text.strip()
    runs = RUN.findall(plain)
    compact = "".join(runs)
    digits = re.sub("[^0-9]", "", compact)
    letters = len(compact) - len(digits)
    if not letters and (body := national(digits, label_type)):
        return (Form(body, NUMBER, DIGIT, DIGIT, PREFIXES),)
    if m := re.fullmatch("([a-z]{2})([0-9]{12,})", compact):
        return (Form(m[2], NUMBER, DIGIT, DIGIT, (m[1],)),)
    if len(digits) >= max(DIGITS, letters):
        files = re.findall(rf"(?<![0-9])([0-9]{{4}})\s*[/{DASHES}]\s*([0-9]{{1,7}})(?![0-9])", plain) if letters else []
        told = dict.fromkeys(year + n for year, n in files if len(year + n) >= DIGITS)
        if told:  # the number tells a file, not the words around it
            return tuple(Form(n, NUMBER, DIGIT, DIGIT) for n in told)
        return (Form(compact, NUMBER, ALNUM if letters else DIGIT, DIGIT),)
    if digits:
        if len(compact) < CLUSTERS:
            return ()
        clusters = re.findall(r"[0-9]+|[^\W\d_]+", plain)
        between = tuple(CLUSTER if i == 0 else NOTHING for c in clusters for i in range(len(c)))[1:]
        return (Form(compact, between, ALNUM if letters else DIGIT, ALNUM if letters else DIGIT, alone=not letters),)
    if letters < LETTERS:
        return ()
    between, gaps = [], BETWEEN.findall(plain[plain.index(runs[0]) :])
    for k, run in enumerate(runs):
        if k:
            gap, symbols = gaps[k - 1], re.sub(r"\s", "", gaps[k - 1])
            if not symbols:
                between.append(SPACED)
            elif symbols in DASHES:
                between.append(HYPHEN)
            elif symbols == "." and len(runs[k - 1]) == 1 and (gap != "." or label_type == "KISI"):
                between.append(INITIAL)
            else:
                between.append(re.compile(r"\s*" + r"\s*".join(map(re.escape, symbols)) + r"\s*"))
        between += [NOTHING] * (len(run) - 1)
    return (Form(compact, tuple(between), ALNUM, ALNUM, capital=plain.isalpha()),)


class Scanner:
    """All values of a matter: (form, label_type, label), longer ones first."""

    def __init__(self, values: Iterable[tuple[str, str, str]]) -> None:
        known: dict[str, list] = {}
        for text, label_type, label in sorted(values, key=lambda v: (-len(v[0]), v)):
            for form in forms_of(label_type, text):
                known.setdefault(form.compact, []).append((-len(text), text, label_type, label, form))
        self.automaton = ahocorasick.Automaton()
        for compact, found in known.items():
            self.automaton.add_word(compact, found)
        self.some = bool(known)
        if known:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, label_type, label) in the text, none over another; a longer value comes before a shorter one."""
        if not self.some:
            return []
        normal = Normalised(text)
        hits = list(self.automaton.iter(BETWEEN.sub("", normal.text)))
        if not hits:
            return []
        c = Compact(normal.text)
        shown = [m.span() for m in SHOWN.finditer(text)] if "{{" in text else []
        found = []
        for last, values in hits:
            for size, name, label_type, label, form in values:
                span = form.span(c, last + 1)
                if span:
                    a, b = normal.place(c.place(span[0])), normal.place(c.place(span[1] - 1)) + 1
                    if not (form.capital and text[a].islower()) and all(b <= x or y <= a for x, y in shown):
                        found.append((size, name, a, b, label_type, label))
        kept: list[tuple[int, int, str, str]] = []
        for _, _, a, b, label_type, label in sorted(found):
            if all(b <= x or y <= a for x, y, *_ in kept):
                kept.append((a, b, label_type, label))
        return sorted(kept)


def cleaned(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, _, label in found:
        out += [text[at:a], label]
        at = b
    return "".join([*out, text[at:]])


#: Lengths of the beginnings by which values are looked for: a place in a text goes on to the next length only if a value has the one
#: before.
STEPS = (3, 6, 12, 24)


def keys_of(label_type: str, value: str) -> set[str]:
    """All letters and digits of each of a value's forms: a text that shows the value has them one after another."""
    return {f.compact for f in forms_of(label_type, value)}


def beginnings(key: str) -> list[str]:
    return [key[:n] for n in STEPS if n <= len(key)]


def met(text: str, lengths: Iterable[int], begins: Callable[[list[str]], Iterable[bool]], known: Callable[[list[str]], Iterable[bool]]) -> list[str]:
    """Which keys of the given lengths a text has, as far as `begins` (of beginnings) and `known` (of keys) tell."""
    c = BETWEEN.sub("", Normalised(text).text)
    out, places = [], range(len(c))
    for n, end in zip((0, *STEPS), (*STEPS, len(c) + 1)):
        if n:
            heads = list({c[i : i + n] for i in places if i + n <= len(c)})
            some = {h for h, b in zip(heads, begins(heads)) if b}
            places = [i for i in places if c[i : i + n] in some]
        found = list({c[i : i + size] for size in lengths if n <= size < end for i in places if i + size <= len(c)})
        out += [k for k, b in zip(found, known(found)) if b]
    return out


def pieces(text: str) -> set[str]:
    """All that keys_of may give of a value that is in the text: `met` without anything to tell. For short texts."""
    every = lambda found: [True] * len(found)
    return set(met(text, range(1, len(text) * 2 + 1), every, every))
