"""JSON texts of unknown shape, mapped string by string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.operators.match import MARK, let

#: What a string can't have as it is.
ESCAPED = r'["\\\x00-\x1f]'
#: A JSON string.
STRING = r'"(?:[^"\\]|\\.)*+"'


def said(string: Column) -> Column:
    """What a JSON string says: what stands between its quotes, unless it has escapes."""
    parsed = F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>")[0]
    return F.when(F.contains(string, F.lit("\\")), parsed).otherwise(F.substring(string, F.lit(2), F.length(string) - 2))


def written(text: Column) -> Column:
    """A text as JSON string: in quotes, unless it has something to escape."""
    made = F.to_json(F.array(text))
    return F.when(text.rlike(ESCAPED), F.substring(made, F.lit(2), F.length(made) - 2)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def mapped(json: Column, change: Callable[[Column], Column], keys: bool = True) -> Column:
    """A JSON text in which every string value, at any depth, and with `keys` every key, is what `change` makes of it; numbers,
    order, white space and all else stay as they are. Strings come to `change` without their escapes. What is no JSON, or has
    an object with a key twice, is null, and so is null.

    Outside of strings JSON has no quotes, so the strings of a text are found without knowing its shape.
    """
    strings = F.regexp_extract_all(json, F.lit(f"({STRING})"), F.lit(1))
    # what lies between them: one more than there are strings. A text without the mark is split at that, which no pattern is compiled for
    between = F.when(F.contains(json, F.lit(MARK)), F.split(json, STRING, -1)).otherwise(F.split(F.regexp_replace(json, STRING, MARK), MARK, -1))
    quoted = lambda s: let(F.coalesce(change(said(s)), F.lit("")), written)

    def whole(x: Column) -> Column:
        is_key = lambda i: F.ltrim(F.get(x["between"], i + 1)).startswith(":") if not keys else F.lit(False)
        pieces = F.transform(x["strings"], lambda s, i: F.concat(F.get(x["between"], i), F.when(is_key(i), s).otherwise(quoted(s))))
        return F.concat(F.array_join(pieces, ""), F.element_at(x["between"], -1))

    # both are made once for a text, not for each of its strings
    parts = F.struct(strings.alias("strings"), between.alias("between"))
    return F.when(F.try_parse_json(json).isNotNull(), let(parts, whole))


def strings_of(json: Column) -> Column:
    """All strings of a JSON text, keys too, without their escapes."""
    strings = F.regexp_extract_all(json, F.lit(f"({STRING})"), F.lit(1))
    return F.when(F.try_parse_json(json).isNotNull(), F.transform(strings, said))
