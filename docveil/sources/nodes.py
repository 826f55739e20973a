"""Text nodes of document packages: what a package's text is made of, and where each piece lies in its XML.

Reading and writing go over the same nodes, so an edit of the text lands where that text was read.
"""

from __future__ import annotations

from dataclasses import dataclass
from xml.parsers import expat

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: WordprocessingML elements with text: runs, deleted runs, and field codes (which are no text of the document).
TEXTS, CODES = ("t", "delText"), ("instrText", "delInstrText")
BREAKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


@dataclass
class Node:
    """Text from `start` of a part's text on, which lies from byte `first` to `end` of the part; of a break, both are -1."""

    text: str
    start: int
    first: int
    end: int


class _Scan:
    """The nodes of one part. expat tells at which byte each event lies; names are by namespace, whatever the prefix."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.seen: set[str] = set()
        self.at, self.open, self.pieces, self.first = 0, None, [], -1
        self.paragraphs = 0

    def read(self, xml: bytes) -> _Scan:
        parser = expat.ParserCreate(namespace_separator="\n")
        parser.buffer_text = False
        self.parser = parser
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.characters
        parser.EntityDeclHandler = self.entity
        parser.Parse(xml, True)
        return self

    def entity(self, *_) -> None:
        raise ValueError("entities are not declared in packages")

    def add(self, text: str, first: int = -1, end: int = -1) -> None:
        self.nodes.append(Node(text, self.at, first, end))
        self.at += len(text)

    def start(self, name: str, attributes: dict) -> None:
        space, _, tag = name.rpartition("\n")
        if space != W:
            return
        if tag in TEXTS:
            self.open, self.pieces, self.first = tag, [], -1
        elif tag in BREAKS:
            self.add(BREAKS[tag])
        elif tag == "p":
            if self.paragraphs:
                self.add("\n")
            self.paragraphs += 1
        elif tag in ("ins", "del", "moveFrom", "moveTo"):
            self.seen.add("tracked changes")

    def characters(self, text: str) -> None:
        if self.open:
            if self.first < 0:
                self.first = self.parser.CurrentByteIndex
            self.pieces.append(text)

    def end(self, name: str) -> None:
        if self.open and name == f"{W}\n{self.open}":
            if self.pieces:
                self.add("".join(self.pieces), self.first, self.parser.CurrentByteIndex)
            self.open = None


def of_part(xml: bytes) -> tuple[list[Node], set[str]]:
    """A WordprocessingML part's nodes, and the warnings that it gives rise to."""
    scan = _Scan().read(xml)
    return scan.nodes, scan.seen


def of_content(xml: bytes) -> tuple[str, int, int]:
    """The text of a UDF package's content.xml, and the bytes from which to which it lies: character data and CDATA sections,
    in any mixture, of the first `content` child of the root."""
    depth, found, place = 0, None, [-1, -1]
    pieces: list[str] = []
    parser = expat.ParserCreate()
    parser.buffer_text = False

    def start(name: str, _: dict) -> None:
        nonlocal depth, found
        if depth == 1 and name == "content" and found is None:
            found = True
            place[0] = -2
        depth += 1

    def mark() -> None:
        if found and place[0] == -2:
            place[0] = parser.CurrentByteIndex

    def characters(text: str) -> None:
        mark()
        if found and place[1] < 0:
            pieces.append(text)

    def end(name: str) -> None:
        nonlocal depth
        depth -= 1
        if depth == 1 and name == "content" and found and place[1] < 0:
            mark()
            place[1] = parser.CurrentByteIndex

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.StartCdataSectionHandler = mark
    parser.Parse(xml, True)
    if found is None:
        raise ValueError("no content")
    return "".join(pieces), place[0], place[1]
