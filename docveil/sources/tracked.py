"""Tracked changes of DOCX packages: written from two versions of a document, read, accepted and rejected.

A document is a list of blocks: a paragraph is a text, a table a list of rows of cells. Blocks of two versions are aligned,
tables row by row and cell by cell, and what differs is written as insertions and deletions. Whatever reader takes the result
gets the new version by accepting all of them and the old one by rejecting all of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.operators.batches import mapped
from docveil.operators.diff import ROW, aligned, word_changes
from docveil.sources.files import Unreadable, W, _open, _plain_parts, docx_nodes, package_of
from docveil.sources.nodes import Node
from docveil.sources.rewrite import repacked

#: Who changed what, and when. Fixed, so that equal versions give equal packages.
AUTHOR, DATE = "docveil", "2000-01-01T00:00:00Z"
#: Characters that XML 1.0 cannot hold.
UNSAYABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: Those, and characters that stand there as something else: a text without any is written as it is.
CARE = re.compile("[\x00-\x1f&<>\ufffe\uffff]")
#: Elements that wrap content that is new, and content that is gone.
NEW, GONE = ("ins", "moveTo"), ("del", "moveFrom")
Block = str | list[list[str]]


class _Writer:
    """Builds a body; every change has a number of its own. Runs have the given properties."""

    def __init__(self):
        self.changes, self.prefix, self.properties = 0, "w:", ""

    def mark(self, tag: str, inner: str = "") -> str:
        self.changes += 1
        p = self.prefix
        # without a namespace, attributes would have none: such a package's prefix is declared here
        own, more = (p, "") if p else ("w:", f' xmlns:w="{W[1:-1]}"')
        return f'<{p}{tag}{more} {own}id="{self.changes}" {own}author="{AUTHOR}" {own}date="{DATE}">{inner}</{p}{tag}>'

    def run(self, text: str, tag: str = "t") -> str:
        p = self.prefix
        if not CARE.search(text):
            return f'<{p}r>{self.properties}<{p}{tag} xml:space="preserve">{text}</{p}{tag}></{p}r>' if text else ""
        if UNSAYABLE.search(text):
            raise Unreadable("a character that XML cannot hold")
        if not ("\t" in text or "\n" in text or "\r" in text):
            return f'<{p}r>{self.properties}<{p}{tag} xml:space="preserve">{escape(text)}</{p}{tag}></{p}r>' if text else ""
        # tabs and line ends are elements of a run, not characters
        parts = "".join(f'<{p}{tag} xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</{p}{tag}>' if x not in "\t\n" else f"<{p}tab/>" if x == "\t" else f"<{p}br/>" for x in _pieces(text))
        return f"<{p}r>{self.properties}{parts}</{p}r>" if parts else ""

    def runs(self, old: str | None, new: str | None) -> str:
        if old is None:
            return self.mark("ins", self.run(new)) if new else ""
        if new is None:
            return self.mark("del", self.run(old, "delText")) if old else ""
        if old == new:
            return self.run(old)
        out = []
        for kind, o, n in word_changes(old, new):
            if kind == "equal" and o == n:
                out.append(self.run(o))
            else:
                out += [self.mark("del", self.run(o, "delText"))] * bool(o) + ([self.mark("ins", self.run(n))] if n else [])
        return "".join(out)

    def paragraph(self, old: str | None, new: str | None) -> str:
        """A paragraph of one version has its end marked as well, so that it goes as a whole."""
        tag = "ins" if old is None else "del" if new is None else None
        end = f"<w:pPr><w:rPr>{self.mark(tag)}</w:rPr></w:pPr>" if tag else ""
        return f"<w:p>{end}{self.runs(old, new)}</w:p>"

    def row(self, old: list[str] | None, new: list[str] | None) -> str:
        tag = "ins" if old is None else "del" if new is None else None
        cells = [(None, x) for x in new] if old is None else [(x, None) for x in old] if new is None else list(zip(old, new))
        body = "".join(f"<w:tc><w:p>{self.runs(o, n)}</w:p></w:tc>" for o, n in cells)
        return f"<w:tr>{f'<w:trPr>{self.mark(tag)}</w:trPr>' if tag else ''}{body}</w:tr>"

    def table(self, old: list[list[str]] | None, new: list[list[str]] | None) -> str:
        """Rows whose numbers of cells differ are a deleted and an added one: cells have no mark that all readers keep."""
        old, new = old or [], new or []
        flat = lambda rows: ["\t".join(r) for r in rows]
        rows = []
        for _, i, j in aligned(flat(old), flat(new), ROW):
            a, b = old[i] if i is not None else None, new[j] if j is not None else None
            rows += [self.row(a, b)] if a is None or b is None or len(a) == len(b) else [self.row(a, None), self.row(None, b)]
        return f"<w:tbl>{''.join(rows)}</w:tbl>"

    def block(self, old: Block | None, new: Block | None) -> str:
        return self.table(old, new) if isinstance(new if old is None else old, list) else self.paragraph(old, new)


def _pieces(text: str) -> list[str]:
    return [x for x in re.split("([\t\n])", text) if x]


def scripted(old: list[Block], new: list[Block]) -> list[tuple[Block | None, Block | None]]:
    """Pairs of blocks in order; a paragraph pairs with a paragraph only, a table with a table only."""
    flat = lambda blocks: ["\n".join("\t".join(r) for r in b) if isinstance(b, list) else b for b in blocks]
    out: list[tuple[Block | None, Block | None]] = []
    for _, i, j in aligned(flat(old), flat(new)):
        a, b = old[i] if i is not None else None, new[j] if j is not None else None
        if i is not None and j is not None and isinstance(a, list) is not isinstance(b, list):
            out += [(a, None), (None, b)]
        else:
            out.append((a, b))
    return out


def tracked_package(old: list[Block], new: list[Block]) -> tuple[bytes, int]:
    """A package that shows the way from one version to the other, and its number of changes."""
    w = _Writer()
    body = "".join(w.block(a, b) for a, b in scripted(old, new))
    return package_of(body), w.changes


P, TBL, TR, TC, RUN, PPR, RPR, TRPR = (W + tag for tag in ("p", "tbl", "tr", "tc", "r", "pPr", "rPr", "trPr"))
_TEXTS = frozenset((f"{W}t", f"{W}delText"))
_BREAKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
_BLOCKS = frozenset((P, TBL, TR, TC))
_PROPERTIES = frozenset((PPR, RPR))
_WRAPPERS = frozenset((f"{W}sdt", f"{W}sdtContent", f"{W}customXml", *(W + t for t in (*NEW, *GONE))))
_DROPPED = {None: frozenset(), True: frozenset(W + t for t in GONE), False: frozenset(W + t for t in NEW)}


def blocks(raw: bytes, accept: bool | None = None) -> list[Block]:
    """The body's paragraphs and tables. accept: None takes a package as it is shown (insertions and deletions both), True
    with all changes accepted, False with all rejected. A paragraph whose end is gone joins what follows it, as in an editor;
    one that is gone as a whole leaves nothing."""
    return readings(raw, (accept,))[0]


def readings(raw: bytes, accepts: Iterable[bool | None]) -> list[list[Block]]:
    """`blocks` in several readings of a package, which is opened once."""
    try:
        plain = _plain_parts(raw, ("word/document.xml",))
        xml = _open(raw).read("word/document.xml") if plain is None else plain["word/document.xml"]
        if b"<!DOCTYPE" in xml:
            raise Unreadable("entities are not declared in packages")
        body = ElementTree.fromstring(xml).find(f"{W}body")
    except (KeyError, ElementTree.ParseError) as e:
        raise Unreadable("word/document.xml is not XML") from e
    if body is None:
        raise Unreadable("no body in the package")
    return [list(_paragraphs(body, _DROPPED[accept])) for accept in accepts]


def _gather(parent: ElementTree.Element, dropped: frozenset[str], out: list[str]) -> list[str]:
    for e in parent:
        tag = e.tag
        if tag in _TEXTS:
            out.append(e.text or "")
        elif tag in _BREAKS:
            out.append(_BREAKS[tag])
        elif tag not in dropped and tag not in _PROPERTIES:
            _gather(e, dropped, out)
    return out


def _end_gone(paragraph: ElementTree.Element, dropped: frozenset[str]) -> bool:
    return any(m.tag in dropped for a in paragraph if a.tag == PPR for b in a if b.tag == RPR for m in b)


def _row_gone(row: ElementTree.Element, dropped: frozenset[str]) -> bool:
    for a in row:
        if a.tag == TRPR:
            for m in a:
                if m.tag in dropped:
                    return True
    return False


def _paragraphs(parent: ElementTree.Element, dropped: frozenset[str]) -> Iterator[Block]:
    held, open_ = "", False
    for e in _content(parent, dropped):
        if e.tag == P:
            own = "".join(_gather(e, dropped, []))
            if dropped and _end_gone(e, dropped):
                held, open_ = held + own, open_ or bool(own)
            else:
                yield held + own
                held, open_ = "", False
        else:
            if open_:
                yield held
            held, open_ = "", False
            kept = [r for r in _content(e, dropped) if r.tag == TR and not (dropped and _row_gone(r, dropped))]
            rows = [[_cell(c, dropped) for c in _content(r, dropped) if c.tag == TC] for r in kept]
            if rows:
                yield rows
    if open_:
        yield held


def _content(parent: ElementTree.Element, dropped: frozenset[str]) -> list[ElementTree.Element]:
    """Paragraphs, tables, rows and cells right below, also those within content controls and changes."""
    out = []
    for e in parent:
        tag = e.tag
        if tag in _BLOCKS:
            out.append(e)
        elif tag in _WRAPPERS and tag not in dropped:
            out += _content(e, dropped)
    return out


def _cell(cell: ElementTree.Element, dropped: frozenset[str]) -> str:
    """A cell's text: its paragraphs a line each; a table within is its rows' cells. Of one paragraph it is the same whether its end
    is gone or not."""
    if len(cell) == 1 and (p := cell[0]).tag == P:
        # most cells are one run of one text
        if len(p) == 1 and p[0].tag == RUN and len(p[0]) == 1 and p[0][0].tag in _TEXTS:
            return p[0][0].text or ""
        return "".join(_gather(p, dropped, []))
    return "\n".join(["\n".join(["\t".join(r) for r in b]) if isinstance(b, list) else b for b in _paragraphs(cell, dropped)])


SHAPE = "array<struct<text: string, rows: array<array<string>>>>"


def _rows(blocks: list[Block]) -> list[tuple]:
    return [(None, b) if isinstance(b, list) else (b, None) for b in blocks]


def _blocks(rows) -> list[Block]:
    return [[["" if c is None else c for c in r] for r in b["rows"]] if b["rows"] is not None else b["text"] or "" for b in (rows if rows is not None else [])]


def tracked(pairs: DataFrame) -> DataFrame:
    """(pair_id, content, changes, error) of pairs (pair_id, old, new), both arrays of blocks (SHAPE). A version that is null is
    empty; a table without rows is nothing. Texts that XML cannot hold give a null content and the reason. A pair is one row."""

    def run(ids: list, old: list, new: list) -> Iterator[tuple]:
        for k, a, b in zip(ids, old, new):
            try:
                yield k, *tracked_package(_blocks(a), _blocks(b)), None
            except Unreadable as e:
                yield k, None, None, str(e)

    kind = pairs.schema["pair_id"].dataType.simpleString()
    shape = lambda name: F.col(name).cast(SHAPE).alias(name)
    return pairs.select("pair_id", shape("old"), shape("new")).transform(mapped, run, f"pair_id {kind}, content binary, changes bigint, error string")


#: What a package may be read as, and what becomes of its changes then.
READINGS = {"shown": None, "accepted": True, "rejected": False}


def versions(packages: DataFrame, keys: list[str], wanted: tuple[str, ...] = tuple(READINGS)) -> DataFrame:
    """(keys, shown, accepted, rejected, error) of packages (keys, content): their blocks in the three readings, or in those that
    are wanted. A package that can't be read has nulls and the reason, which never quotes it."""

    def run(*columns: list) -> Iterator[tuple]:
        for *key, raw in zip(*columns):
            try:
                yield *key, *map(_rows, readings(raw, [READINGS[n] for n in wanted])), None
            except Unreadable as e:
                yield *key, *(None for _ in wanted), str(e)
            except Exception as e:
                yield *key, *(None for _ in wanted), type(e).__name__

    own = ", ".join(f"`{k}` {packages.schema[k].dataType.simpleString()}" for k in keys)
    return mapped(packages.select(*keys, "content"), run, ", ".join([own, *(f"{n} {SHAPE}" for n in wanted), "error string"]))


class _Runs:
    """The runs of a part with text: from which byte to which each lies, its properties, its prefix, and if a tracked change
    holds it."""

    def __init__(self, xml: bytes):
        self.xml, self.found = xml, []
        self.open: list[list] = []
        self.depth = self.tracked = 0
        parser = self.parser = expat.ParserCreate(namespace_separator="\n")
        parser.StartElementHandler, parser.EndElementHandler = self.start, self.end
        parser.Parse(xml, True)
        self.found.sort()
        self.firsts = [r[0] for r in self.found]

    def start(self, name: str, _: dict) -> None:
        self.depth += 1
        tag = "{" + name.replace("\n", "}")
        at = self.parser.CurrentByteIndex
        if tag == f"{W}r":
            prefix = re.match(rb"<((?:[^\s:<>/]+:)?)r\b", self.xml[at : at + 80])[1].decode()
            self.open.append([at, b"", prefix, self.tracked > 0, self.depth, 0])
        elif tag == f"{W}rPr" and self.open and self.depth == self.open[-1][4] + 1:
            self.open[-1][5] = at
        elif tag in {W + t for t in (*NEW, *GONE)}:
            self.tracked += 1

    def end(self, name: str) -> None:
        tag = "{" + name.replace("\n", "}")
        stop = self.xml.index(b">", self.parser.CurrentByteIndex) + 1
        if tag == f"{W}r":
            first, properties, prefix, tracked, *_ = self.open.pop()
            self.found.append((first, stop, properties, prefix, tracked))
        elif tag == f"{W}rPr" and self.open and self.depth == self.open[-1][4] + 1:
            self.open[-1][1] = self.xml[self.open[-1][5] : stop]
        elif tag in {W + t for t in (*NEW, *GONE)}:
            self.tracked -= 1
        self.depth -= 1

    def at(self, byte: int) -> tuple | None:
        """The innermost run that holds a byte."""
        k = bisect_right(self.firsts, byte) - 1
        while k >= 0 and self.found[k][1] <= byte:
            k -= 1
        return self.found[k] if k >= 0 else None


#: What becomes of a revision.
APPLIED, EMPTY, CROSSES, MISSING, SEVERAL, CLASHES, HELD, UNSAID = "applied", "empty", "crosses a paragraph", "not found", "several places", "overlaps another", "tracked or no plain text", "a character that XML cannot hold"
Revision = tuple[str, str, bool]


def _places(text: str, old: str) -> list[int]:
    out, at = [], text.find(old)
    while at >= 0:
        out.append(at)
        at = text.find(old, at + len(old))
    return out


def revised_package(raw: bytes, revisions: list[Revision]) -> tuple[bytes, list[str]]:
    """A package with revisions (old, new, every place) as tracked changes, and what became of each. A run is cut where a change
    begins and ends, and all its pieces keep its properties; nothing else of the package changes. A revision is done at all its
    places or at none. Of revisions that overlap, the first one counts."""
    nodes, _ = docx_nodes(raw)
    text = "".join(n.text for _, n in nodes)
    starts = [n.start for _, n in nodes]
    z = _open(raw)
    parts = {name: z.read(name) for name in {part for part, _ in nodes}}
    runs = {name: _Runs(xml) for name, xml in parts.items()}
    taken: list[tuple[int, int, str]] = []
    statuses = []

    def touched(a: int, b: int) -> list[tuple[str, Node]]:
        k = bisect_right(starts, a) - 1
        out = []
        while k < len(nodes) and nodes[k][1].start < b:
            if nodes[k][1].start + len(nodes[k][1].text) > a:
                out.append(nodes[k])
            k += 1
        return out

    def plain(a: int, b: int) -> bool:
        for part, n in touched(a, b):
            run = runs[part].at(n.first) if n.first >= 0 else None
            if run is None or run[4] or b"<![CDATA[" in parts[part][run[0] : run[1]]:
                return False
        return True

    for old, new, every in revisions:
        places = _places(text, old) if old and "\n" not in old else []
        spans = [(a, a + len(old)) for a in places]
        if not old:
            status = EMPTY
        elif "\n" in old:
            status = CROSSES
        elif UNSAYABLE.search(new):
            status = UNSAID
        elif not places:
            status = MISSING
        elif len(places) > 1 and not every:
            status = SEVERAL
        elif _clash(taken, spans):
            status = CLASHES
        elif not all(plain(a, b) for a, b in spans):
            status = HELD
        else:
            status = APPLIED
            taken = sorted(taken + [(a, b, new) for a, b in spans])
        statuses.append(status)

    # of each node: from where to where it loses text, and what comes there
    cuts: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
    which: dict[tuple[str, int], Node] = {}
    for a, b, new in taken:
        for k, (part, n) in enumerate(touched(a, b)):
            which[part, n.first] = n
            cuts.setdefault((part, n.first), []).append((max(a - n.start, 0), min(b - n.start, len(n.text)), "" if k else new))
    # numbers go on from those that the package has
    w = _Writer()
    w.changes = max((int(x) for xml in parts.values() for x in re.findall(rb"\bid\s*=\s*[\"'](\d{1,9})[\"']", xml)), default=0)
    for (part, first), own in sorted(cuts.items(), reverse=True):
        n, (_, _, properties, w.prefix, _) = which[part, first], runs[part].at(first)
        w.properties = properties.decode()
        p, body, at = w.prefix, "", 0
        for lo, hi, new in sorted(own):
            body += escape(n.text[at:lo]) + f"</{p}t></{p}r>"
            body += w.mark("del", w.run(n.text[lo:hi], "delText")) + (w.mark("ins", w.run(new)) if new else "")
            body += f'<{p}r>{w.properties}<{p}t xml:space="preserve">'
            at = hi
        body += escape(n.text[at:])
        xml = parts[part]
        opening = xml.rindex(b"<", 0, first)
        tag = xml[opening:first]
        if b"xml:space" not in tag:
            tag = tag[:-1] + b' xml:space="preserve">'
        parts[part] = xml[:opening] + tag + body.encode() + xml[n.end :]
    return repacked(raw, parts), statuses


def _clash(taken: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> bool:
    """Do spans meet any of those taken? Both are in order and disjoint."""
    firsts = [a for a, *_ in taken]
    for a, b in spans:
        k = bisect_right(firsts, b - 1)
        if k and taken[k - 1][1] > a:
            return True
    return False


def revised(packages: DataFrame, revisions: DataFrame) -> DataFrame:
    """(path, content, results, error): packages (path, content) with revisions (path, position, old, new, every) as tracked
    changes; results are (position, status) by position. Null texts count as empty. A package that can't be read has a null
    content and the reason. A package's revisions are one array."""
    wanted = F.array_sort(F.collect_list(F.struct("position", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"), F.coalesce("every", F.lit(False)).alias("every"))))
    rows = packages.select("path", "content").join(revisions.groupBy("path").agg(wanted.alias("wanted")), "path", "left")

    def run(paths: list, packages: list, asked: list) -> Iterator[tuple]:
        for path, raw, todo in zip(paths, packages, asked):
            todo = todo or []
            try:
                content, statuses = revised_package(raw, [(t["old"], t["new"], t["every"]) for t in todo])
                yield path, content, [{"position": t["position"], "status": x} for t, x in zip(todo, statuses)], None
            except Unreadable as e:
                yield path, None, None, str(e)
            except Exception as e:
                yield path, None, None, type(e).__name__

    kind = packages.schema["path"].dataType.simpleString()
    return mapped(rows, run, f"path {kind}, content binary, results array<struct<position: int, status: string>>, error string")
