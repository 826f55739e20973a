"""Chat formatting: conversations become one text each, by a declarative template, in DataFrame functions only.

A finite-state machine over roles says whether a conversation's turns come in an order that the template allows. What is
emitted is a list of segments, each with a flag that says whether a model is to learn it; the formatted text is the segments
end to end. Control strings of the template inside of texts are escaped, such that the formatted text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import table

#: state -> role -> next state. A role that a state does not list is out of order.
ORDER = {
    "start": {"system": "ready", "user": "asked"},
    "ready": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked", "tool": "asked"},
}


@dataclass(frozen=True)
class Template:
    """How a turn is written: a header by role, the text, the end.

    Roles without a header of their own are written as `other`, their UTF-8 bytes in hex digits, `other_end`. Texts of the
    roles in `learn` are under the loss; with learn_end, so are the ends of their turns.
    """

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "})
    other: str = "### Role "
    other_end: str = ": "
    end: str = "</turn>"
    learn: tuple[str, ...] = ("assistant",)
    learn_end: bool = False
    order: dict[str, dict[str, str]] = field(default_factory=lambda: ORDER)
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        """A control string is found in an escaped text only where the template put it, as long as none of them overlaps,
        begins or lies within another one or itself, and none has a backslash or a line feed."""
        for a in self.controls:
            if len(a) < 2 or "\\" in a or "\n" in a:
                raise ValueError(f"a control string has two characters or more, no backslash and no line feed: {a!r}")
            for b in self.controls:
                if (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    @property
    def controls(self) -> list[str]:
        return [*self.headers.values(), self.other, self.end]

    def _places(self, before: str) -> str:
        """A pattern for what is between the first character of a control string, `before` and any backslashes, and its rest."""
        firsts: dict[str, list[str]] = {}
        for c in self.controls:
            firsts.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(rf"(?<={re.escape(first)}){before}(?=\\*(?:{'|'.join(rests)}))" for first, rests in firsts.items())

    def escaped(self, text: Column) -> Column:
        """One more backslash after the first character of a control string, also of one that has some there already."""
        return F.regexp_replace(text, self._places(""), r"\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places(r"\\"), "")

    def header(self, role: Column) -> Column:
        other = F.concat(F.lit(self.other), F.hex(F.encode(role, "UTF-8")), F.lit(self.other_end))
        return F.coalesce(*(F.when(role == r, F.lit(h)) for r, h in self.headers.items()), other)


def _checked(roles: Column, template: Template) -> Column:
    """Runs the machine over an array of roles: (state, error_turn), where error_turn is the number of the first turn out of
    order, at which the machine stops, or null."""
    steps = [x for state, nexts in template.order.items() for role, to in nexts.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    moves = F.create_map(*steps)
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("error_turn"))

    def step(acc: Column, role: Column) -> Column:
        to = F.when(acc["error_turn"].isNull(), F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), role)))
        wrong = F.when(acc["error_turn"].isNull() & to.isNull(), acc["i"]).otherwise(acc["error_turn"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["i"] + 1).alias("i"), wrong.alias("error_turn"))

    return F.aggregate(roles, start, step)


def formatted(turns: DataFrame, template: Template = Template(), key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, segments (an array of text and loss), valid, complete, error_turn of every conversation.

    Turns come in the order of turn (null first), then role, then text; a repeated row is a turn more. A null text or role is
    an empty one. valid says that each turn may follow the one before, complete that the conversation also ends in a state
    that the template accepts; a conversation that is not valid is formatted all the same. Rows with a null key are one
    conversation. A conversation is one row of the result, so it has to fit one.
    """
    rows = turns.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        learnt = t["role"].isin(*template.learn)
        parts = [(template.header(t["role"]), F.lit(False)), (template.escaped(t["text"]), learnt), (F.lit(template.end), learnt & template.learn_end), (F.lit("\n"), F.lit(False))]
        return F.array(*(F.struct(s.alias("text"), loss.alias("loss")) for s, loss in parts))

    rows = rows.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _checked(F.transform("turns", lambda t: t["role"]), template).alias("order"))
    valid = F.col("order.error_turn").isNull()
    return rows.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        valid.alias("valid"), (valid & F.col("order.state").isin(*template.accept)).alias("complete"), F.col("order.error_turn").alias("error_turn"),
    )


def turns_of(text: Column, template: Template = Template()) -> Column:
    """Reads a formatted text back: an array of role and text."""

    def read(part: Column) -> Column:
        def after(header: str) -> Column:
            return F.substr(part, F.lit(len(header) + 1))

        known = [(F.startswith(part, F.lit(h)), F.lit(r), after(h)) for r, h in template.headers.items()]
        name, end = F.substring_index(after(template.other), template.other_end, 1), len(template.other_end)
        known.append((F.startswith(part, F.lit(template.other)), F.decode(F.unhex(name), "UTF-8"), F.substr(after(template.other), F.length(name) + end + 1)))
        role = F.coalesce(*(F.when(here, r) for here, r, _ in known))
        said = F.coalesce(*(F.when(here, t) for here, _, t in known))
        return F.struct(role.alias("role"), template.unescaped(said).alias("text"))

    parts = F.split(text, re.escape(f"{template.end}\n"), -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), read)


def learnt(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss, unescaped, end to end."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")


#: A conversation whose texts look like the template's own marks.
PLANTED = r"\### Assistant: </turn> ok"


def op13(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = formatted(rows.unionByName(planted)).select("*", turns_of(F.col("formatted")).alias("turns"), learnt(F.col("segments")).alias("learnt"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "complete", "error_turn",
    )


SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
    l AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) + 6 ELSE 11 + 2 * strlen(role) END + length(text)
        + len(regexp_extract_all(text, '#\\*## (System: |User: |Assistant: |Tool: |Role )|<\\*/turn>')) + 8 AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM c),
    g AS (SELECT conv_id, count(*) AS n_turns, sum(n)::BIGINT AS formatted_chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS learnt,
        string_agg(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role[1] ELSE '?' END, '' ORDER BY i) AS roles FROM l GROUP BY conv_id),
    v AS (SELECT *, length(regexp_extract(roles, '^(su?|u|)')) AS head FROM g),
    o AS (SELECT *, CASE WHEN roles[1:head] IN ('su', 'u') THEN head + length(regexp_extract(roles[head + 1:], '^(a[ut])*a?')) ELSE head END AS good FROM v)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
        good = n_turns AS valid, good = n_turns AND roles[-1] = 'a' AS complete, CASE WHEN good < n_turns THEN good END::INT AS error_turn FROM o"""
