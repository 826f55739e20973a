"""DOCX packages as Markdown, with the numbers that their lists show, and Markdown as packages.

Which list and level a paragraph is of follows from itself or from its style and those that this is based on; counters belong to
abstract lists, so lists that share one go on counting. A package is one sequence of paragraphs, read in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from pyspark.sql import DataFrame

from docveil.functions.numerals import ROMAN
from docveil.operators.batches import mapped
from docveil.sources.files import Unreadable, W, docx_package, parts
from docveil.sources.nodes import BREAKS

#: The parts that a view is made of.
BODY, STYLES, NUMBERING = (f"word/{x}.xml" for x in ("document", "styles", "numbering"))
#: List levels that a package can have.
DEPTH = 9


def counted(n: int, form: str) -> str:
    """n as a list of that form shows it (see `functions.numerals`, which says the same in columns)."""
    if form.endswith("Roman"):
        digit = lambda k, one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten][n // 10**k % 10]
        out = "m" * (n // 1000) + "".join(digit(k, *ROMAN[k]) for k in (2, 1, 0))
    elif form.endswith("Letter"):
        out = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1)
    else:
        return f"{n:02d}" if form == "decimalZero" else str(n)
    return (out.upper() if form.startswith("upper") else out) if n > 0 else "0"


@cache
def _path(path: str) -> str:
    return "/".join(W + x for x in path.split("/"))


def _val(parent: Element | None, path: str) -> str | None:
    found = parent.find(_path(path)) if parent is not None else None
    return found.get(W + "val") if found is not None else None


def _int(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch("[0-9]{1,9}", text) else otherwise


@lru_cache(1000)
def _named(style: str) -> int:
    """The level of a heading whose style is called so."""
    m = re.search(r"(?:heading|başlık|balk) ?([1-9])", style)
    return min(int(m[1]), 6) if m else int(bool(re.search(r"\btitle\b", style)))


class Lists:
    """The styles and lists of a package, and how far its lists have counted."""

    def __init__(self, styles: Element | None, numbering: Element | None):
        self.styles = {s.get(W + "styleId"): s for s in styles.iter(W + "style")} if styles is not None else {}
        every = list(numbering) if numbering is not None else []
        self.abstract = {a.get(W + "abstractNumId"): a for a in every if a.tag == W + "abstractNum"}
        self.lists = {n.get(W + "numId"): n for n in every if n.tag == W + "num"}
        self.counts: dict[str, list[int | None]] = {}
        self.begun: set[str] = set()

    def chain(self, paragraph: Element) -> list[Element]:
        """A paragraph's properties, then those of its style and of what that is based on; circles end."""
        own = paragraph.find(W + "pPr")
        out, style, seen = [own] if own is not None else [], _val(own, "pStyle"), set()
        while style in self.styles and style not in seen:
            seen.add(style)
            properties = self.styles[style].find(W + "pPr")
            out += [properties] if properties is not None else []
            style = _val(self.styles[style], "basedOn")
        return out

    def heading(self, paragraph: Element) -> int:
        """1 to 6 by the outline level, else by what the style is called; 0 for no heading."""
        chain = self.chain(paragraph)
        outline = next((v for v in (_val(p, "outlineLvl") for p in chain) if v is not None), None)
        if outline is not None:
            return min(_int(outline, 9) + 1, 6) if _int(outline, 9) < 9 else 0
        style = _val(paragraph, "pPr/pStyle") or ""
        return _named(f"{style} {_val(self.styles.get(style), 'name') or ''}".lower())

    def of(self, num: str) -> Element | None:
        """A list's abstract list, also through the style that it links to."""
        found = self.abstract.get(_val(self.lists.get(num), "abstractNumId"))
        link = _val(found, "numStyleLink")
        linked = _val(self.styles.get(link), "pPr/numPr/numId") if link else None
        return found if linked in (None, num) or linked not in self.lists else self.abstract.get(_val(self.lists[linked], "abstractNumId"))

    def label(self, paragraph: Element) -> str | None:
        """The label of a list paragraph, `-` for a bullet; null for others. Counts on, so it is asked once a paragraph, in order."""
        if not self.abstract:
            return None
        chain = self.chain(paragraph)
        num = next((v for v in (_val(p, "numPr/numId") for p in chain) if v is not None), None)
        found = self.of(num) if num and num != "0" else None
        if found is None:
            return None
        level = min(_int(next((v for v in (_val(p, "numPr/ilvl") for p in chain) if v is not None), None), 0), DEPTH - 1)
        levels = {_int(x.get(W + "ilvl"), 0): x for x in found.findall(W + "lvl")}
        start = lambda k: _int(_val(levels.get(k), "start"), 1)
        form = lambda k: _val(levels.get(k), "numFmt") or "decimal"
        counts = self.counts.setdefault(found.get(W + "abstractNumId"), [None] * DEPTH)
        if num not in self.begun:
            self.begun.add(num)
            for override in self.lists[num].findall(W + "lvlOverride"):
                k, first = _int(override.get(W + "ilvl"), 0), _val(override, "startOverride")
                if first is not None and k < DEPTH:
                    counts[k:] = [_int(first, 1) - 1] + [None] * (DEPTH - k - 1)
        now = counts[level]
        counts[level:] = [start(level) if now is None else now + 1] + [None] * (DEPTH - level - 1)
        if form(level) in ("bullet", "none"):
            return "-" if form(level) == "bullet" else None
        legal = levels.get(level) is not None and levels[level].find(W + "isLgl") is not None

        def shown(m: re.Match) -> str:
            k = int(m[1]) - 1
            return counted(counts[k] if counts[k] is not None else start(k), "decimal" if legal else form(k))

        return re.sub("%([1-9])", shown, _val(levels.get(level), "lvlText") or "").strip() or None


P, PROPERTIES, RUN, LOOKS, T, CELL, ROW, TABLE = (W + x for x in ("p", "pPr", "r", "rPr", "t", "tc", "tr", "tbl"))
SAYS = {T: None} | {W + tag: text for tag, text in BREAKS.items()}


def _text(paragraph: Element) -> str:
    # tabs among the properties are stops, no characters
    stops = {id(e) for p in paragraph.iter(PROPERTIES) for e in p.iter()}
    return "".join([SAYS[e.tag] or e.text or "" for e in paragraph.iter() if e.tag in SAYS and id(e) not in stops])


AROUND = {W + x for x in ("sdt", "sdtContent", "customXml", "ins")}


def _blocks(parent: Element) -> Iterator[Element]:
    for e in parent:
        if e.tag in (P, TABLE):
            yield e
        elif e.tag in AROUND:
            yield from _blocks(e)


def _plain(paragraph: Element) -> str | None:
    """The text of a paragraph that is runs of text alone: without properties, it is of no list and no heading. Null for others."""
    text = ""
    for run in paragraph:
        if run.tag != RUN:
            return None
        for e in run:
            if e.tag == T and not len(e):
                text += e.text or ""
            elif e.tag != LOOKS or any(x.tag in SAYS for x in e.iter()):
                return None
    return text.strip()


def _line(paragraph: Element, lists: Lists) -> str:
    plain = _plain(paragraph)
    if plain is not None:
        return plain
    text, label, level = _text(paragraph).strip(), lists.label(paragraph), lists.heading(paragraph)
    return " ".join(x for x in ("#" * level, label, text) if x) if text else ""


def _cells(table: Element) -> list[list[str]] | None:
    """The cells of a table that is rows of cells of plain paragraphs alone; null for others."""
    rows = []
    for row in table:
        if row.tag != ROW:
            return None
        cells = []
        for cell in row:
            if cell.tag != CELL:
                return None
            lines = []
            for paragraph in cell:
                line = _plain(paragraph) if paragraph.tag == P else None
                if line is None:
                    return None
                if line:
                    lines.append(line)
            cells.append("<br>".join(lines))
        rows.append(cells)
    return rows


def _grid(table: Element, lists: Lists) -> list[str]:
    """A table's rows with text, as wide as the widest; line ends and paragraphs in cells are <br>, and | is escaped."""
    rows = _cells(table)
    if rows is None:
        cell = lambda c: "<br>".join(x for x in (_line(p, lists) for p in c.iter(P)) if x)
        rows = [[cell(c) for c in r.iter(CELL)] for r in table.findall(ROW)]
    rows = [[c.replace("\n", "<br>").replace("|", "\\|") for c in r] for r in rows if any(r)]
    wide = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return lines[:1] + ["|" + "---|" * wide] * bool(lines) + lines[1:]


def view(raw: bytes) -> str:
    """A package's body as Markdown: headings, numbered and bulleted lists, tables; blocks without text are one blank line, and
    tables stand between blank lines. Deleted text is not shown."""
    held = parts(raw, (BODY, STYLES, NUMBERING))

    def part(name: str) -> Element | None:
        try:
            return ElementTree.fromstring(held[name]) if name in held else None
        except ElementTree.ParseError as e:
            raise Unreadable(f"{name} is not XML") from e

    document = part(BODY)
    body = document.find(W + "body") if document is not None else None
    if body is None:
        raise Unreadable("no document in the package")
    lists, lines = Lists(part(STYLES), part(NUMBERING)), []
    for block in _blocks(body):
        lines += [_line(block, lists)] if block.tag == P else ["", *_grid(block, lists), ""]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def views(packages: DataFrame) -> DataFrame:
    """(path, markdown, error) of packages (path, content); what cannot be read has a null Markdown and the reason."""

    def read(path: object, raw: bytes | None) -> tuple:
        try:
            return path, view(raw or b""), None
        except Unreadable as e:
            return path, None, str(e)

    return mapped(packages.select("path", "content"), lambda *columns: map(read, *columns), f"path {packages.schema['path'].dataType.simpleString()}, markdown string, error string")


def packages(texts: DataFrame) -> DataFrame:
    """(path, content): DOCX packages of Markdown (path, markdown); null is an empty document."""
    made = lambda paths, texts: zip(paths, (docx_package(t or "") for t in texts))
    return mapped(texts.select("path", "markdown"), made, f"path {texts.schema['path'].dataType.simpleString()}, content binary")
