"""Turkish endings: reading a chain of them and putting it on another word in that word's vowel harmony, as columns.

Endings stand in slots, one after another: plural, whose, case, `ki`, copula. A chain is parsed by going through the slots,
each of which may be empty; what does not parse to its end is no chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.functions.textfold import tr_lower
from docveil.operators.match import let

#: Vowels with their place and lips. Lips decide among high vowels after a word's last vowel; û takes unrounded endings here.
FEATURES = {
    "a": ("back", "flat"), "e": ("front", "flat"), "ı": ("back", "flat"), "i": ("front", "flat"),
    "o": ("back", "round"), "ö": ("front", "round"), "u": ("back", "round"), "ü": ("front", "round"),
    "â": ("back", "flat"), "î": ("front", "flat"), "û": ("back", "flat"),
}
VOWELS = "".join(FEATURES)
#: Consonants without voice: d hardens to t after them.
VOICELESS = "".join("ç f h k p s ş t".split())
LOW = {"back": "a", "front": "e"}
HIGH = {("back", "flat"): "ı", ("back", "round"): "u", ("front", "flat"): "i", ("front", "round"): "ü"}

#: Two ways through the slots. A is a low vowel, I a high one, D is d or t. A letter in parentheses comes only where it keeps
#: two vowels apart, or two consonants. After `(s)I`, its, cases begin with n.
CHAINS = [
    [("lAr",), ("(I)mIz", "(I)nIz"), ("(y)A", "(y)I", "(n)In", "(y)lA", "DA", "DAn"), ("ki",), ("DIr",)],
    [("lAr",), ("(s)I",), ("nA", "nI", "nIn", "ylA", "nDA", "nDAn"), ("ki",), ("DIr",)],
]
ENDINGS = list(dict.fromkeys(e for chain in CHAINS for slot in chain for e in slot))


def shape(ending: str) -> str:
    """The pattern of an ending in any harmony."""
    letters = {"A": f"[{''.join(LOW.values())}]", "I": f"[{''.join(HIGH.values())}]", "D": "[dt]", "(": "(?:", ")": ")?"}
    return "".join(letters.get(c, c) for c in ending)


def _having(place: str | None = None, lips: str | None = None) -> str:
    return "[" + "".join(v for v, (p, r) in FEATURES.items() if place in (None, p) and lips in (None, r)) + "]"


def put_on(word: Column, ending: str) -> Column:
    """word with one ending."""
    vowel, open_end = F.regexp_extract(word, f"([{VOWELS}])[^{VOWELS}]*$", 1), word.rlike(f"[{VOWELS}]$")
    back, rounded = vowel.rlike(_having("back")), vowel.rlike(_having(None, "round"))
    high = lambda place: F.when(rounded, HIGH[place, "round"]).otherwise(HIGH[place, "flat"])
    letters = {
        "A": F.when(back, LOW["back"]).otherwise(LOW["front"]),
        "I": F.when(back, high("back")).otherwise(high("front")),
        "D": F.when(word.rlike(f"[{VOICELESS}]$"), "t").otherwise("d"),
    }
    parts = [word]
    if ending[0] == "(":
        apart, ending = ending[1], ending[3:]
        parts.append(F.when(~open_end, letters["I"]).otherwise("") if apart == "I" else F.when(open_end, apart).otherwise(""))
    return F.concat(*parts, *(letters.get(c, F.lit(c)) for c in ending))


def _parsed(low: Column) -> Column:
    """The endings of a chain, by their names in ENDINGS; null for what is none."""
    ways = []
    for chain in CHAINS:
        pattern = "^" + "".join("(" + "|".join(f"(?:{shape(e)})" for e in slot) + ")?" for slot in chain) + "$"
        names = []
        for k, slot in enumerate(chain, 1):
            part = F.regexp_extract(low, pattern, k)
            names.append(F.coalesce(*(F.when(part.rlike(f"^{shape(e)}$"), F.lit(e)) for e in slot)))
        ways.append(F.when((low != "") & low.rlike(pattern), F.array_compact(F.array(*names))))
    return F.coalesce(*ways)


def inflected(word: Column, suffix: Column) -> Column:
    """The endings of suffix as they are on the last word of `word`. A suffix that is no chain of endings stays as it is, and
    so does one after a word without vowels or one that does not end with a letter."""
    stem = tr_lower(F.coalesce(F.try_element_at(F.split(F.trim(word), r"\s+"), F.lit(-1)), F.lit("")))

    def step(grown: Column, name: Column) -> Column:
        return F.coalesce(*(F.when(name == e, put_on(grown, e)) for e in ENDINGS))

    def body(x: Column) -> Column:
        fits = x["chain"].isNotNull() & x["stem"].rlike(r"\p{L}$") & x["stem"].rlike(f"[{VOWELS}]")
        return F.when(fits, F.substring(F.aggregate(x["chain"], x["stem"], step), F.length(x["stem"]) + 1, F.lit(1 << 20)))

    return F.coalesce(let(F.struct(stem.alias("stem"), _parsed(tr_lower(suffix)).alias("chain")), body), suffix)
