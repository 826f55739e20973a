"""Document files as tables: text, Markdown, DOCX and UDF packages, read through Spark's binary source."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.sources.nodes import Node, of_content, of_part

#: The most entries, and unpacked bytes, of an archive that is opened. Fixed values.
ENTRIES, UNPACKED = 5000, 400 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Kinds of parts with text, in the order in which their texts follow each other.
KINDS = ("document", "header", "footer", "footnotes", "endnotes", "comments")
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


class Unreadable(ValueError):
    pass


def _open(raw: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise Unreadable("not an archive") from e
    if len(z.infolist()) > ENTRIES or sum(i.file_size for i in z.infolist()) > UNPACKED:
        raise Unreadable("the archive is too large")
    return z


def _plain_parts(raw: bytes, wanted: tuple[str, ...]) -> dict[str, bytes] | None:
    """The wanted entries of an archive without comments, codes and other oddities; null if it has any, or does not hold true."""
    at = len(raw) - 22
    if at < 0 or not raw.startswith(b"PK\5\6", at):
        return None
    *disks, here, count, size, first, comment = struct.unpack_from("<4H2LH", raw, at + 4)
    if any(disks) or comment or here != count or count > ENTRIES or first + size != at:
        return None
    out, total = {}, 0
    for _ in range(count):
        if not raw.startswith(b"PK\1\2", first) or first + 46 > at:
            return None
        flags, method, _, _, crc, packed, unpacked, name, extra, note, *_, local = struct.unpack_from("<4H3L3H2HLL", raw, first + 8)
        title = raw[first + 46 : first + 46 + name]
        first, total = first + 46 + name + extra + note, total + unpacked
        if flags or extra or note or not title.isascii() or b"\0" in title or title.decode() in out or total > UNPACKED:
            return None
        if (title := title.decode()) not in wanted:
            continue
        begin = local + 30 + name
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or raw[local : local + 4] != b"PK\3\4" or raw[local + 26 : begin] != struct.pack("<2H", name, 0) + title.encode():
            return None
        data = raw[begin : begin + packed]
        if method == zipfile.ZIP_DEFLATED:
            try:
                data = zlib.decompressobj(-15).decompress(data, unpacked + 1)
            except zlib.error:
                return None
        if len(data) != unpacked or zlib.crc32(data) != crc:
            return None
        out[title] = data
    return out if first == at else None


def parts(raw: bytes, wanted: tuple[str, ...]) -> dict[str, bytes]:
    """Those of the wanted parts that a package has. Plain archives, which most are, are read as they stand, others as any archive."""
    found = _plain_parts(raw, wanted)
    if found is None:
        z = _open(raw)
        try:
            found = {name: z.read(name) for name in set(z.namelist()).intersection(wanted)}
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
            raise Unreadable("a part cannot be unpacked") from e
    return found


def docx_parts(z: zipfile.ZipFile) -> list[str]:
    """The names of a package's parts with text, in order."""
    stems = {n: re.fullmatch(r"word/([a-z]+)\d*\.xml", n) for n in z.namelist()}
    found = sorted((KINDS.index(m[1]), len(n), n) for n, m in stems.items() if m and m[1] in KINDS)
    if "word/document.xml" not in z.namelist():
        raise Unreadable("no document in the package")
    return [n for *_, n in found]


def docx_nodes(raw: bytes) -> tuple[list[tuple[str, Node]], list[str]]:
    """(part, node) of all text in a package, places counted over the whole text, in which a line end parts the parts; and
    warnings."""
    z = _open(raw)
    out, at, seen = [], 0, set()
    for name in docx_parts(z):
        try:
            found, warnings = of_part(z.read(name))
        except (ExpatError, ValueError) as e:
            raise Unreadable(f"{name} is not XML") from e
        if out and found:
            out.append((name, Node("\n", at, -1, -1)))
            at += 1
        out += [(name, Node(n.text, at + n.start, n.first, n.end)) for n in found]
        at += sum(len(n.text) for n in found)
        seen |= warnings | ({"comments"} if name.startswith("word/comments") else set())
    folders = {"word/media/": "media", "word/embeddings/": "embedded objects"}
    seen |= {what for folder, what in folders.items() for n in z.namelist() if n.startswith(folder)}
    return out, sorted(seen)


def docx_text(raw: bytes) -> tuple[str, list[str]]:
    """A package's text (the body, then headers, footers, notes and comments; deleted runs too) and warnings."""
    nodes, seen = docx_nodes(raw)
    return "".join(n.text for _, n in nodes), seen


def udf_text(raw: bytes) -> tuple[str, list[str]]:
    """The text of a UDF package: all character data of its content.xml's content."""
    z = _open(raw)
    if "content.xml" not in z.namelist():
        raise Unreadable("no content.xml in the package")
    try:
        return of_content(z.read("content.xml"))[0], []
    except (ExpatError, ValueError) as e:
        raise Unreadable("no content in content.xml") from e


def udf_package(text: str) -> bytes:
    """A UDF package: one paragraph a line, its place and length in UTF-16 units, line end included."""
    units = lambda s: len(s.encode("utf-16-le")) // 2
    at, paragraphs = 0, []
    text = re.sub("\r\n?", "\n", text)  # as XML reads line ends
    for line in re.findall(r"[^\n]*\n|[^\n]+", text) or [""]:
        paragraphs.append(f'<paragraph><content startOffset="{at}" length="{units(line)}"/></paragraph>')
        at += units(line)
    body = text.replace("]]>", "]]]]><![CDATA[>")
    xml = f'<?xml version="1.0" encoding="UTF-8"?><template><content><![CDATA[{body}]]></content><elements>{"".join(paragraphs)}</elements></template>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", xml)
    return out.getvalue()


def _begun() -> bytes:
    """An archive with the parts that are the same in all packages."""
    types = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", rels)
    return out.getvalue()


BEGUN = _begun()
DOCUMENT = b"word/document.xml"


def package_of(body: str) -> bytes:
    """A DOCX package of a body's XML. All but one part is the same in all packages, so that one's entry is put behind the others
    as it stands in an archive, without reading these again. (A row has less than the 4 GB that such an entry can say.)"""
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'.encode()
    size, first = struct.unpack("<2L", BEGUN[-10:-2])  # of the directory
    packed = zlib.compress(document, 1, -15)
    entry = struct.pack("<5H3L2H", 20, 0, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(document), len(packed), len(document), len(DOCUMENT), 0)
    local = b"PK\3\4" + entry + DOCUMENT + packed
    directory = BEGUN[first : first + size] + b"PK\1\2\x14\0" + entry + struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, first) + DOCUMENT
    return b"".join((BEGUN[:first], local, directory, b"PK\5\6", struct.pack("<4H2LH", 0, 0, 3, 3, len(directory), first + len(local), 0)))


BAR, RULE, HEADING, BULLET = map(re.compile, (r"(?<!\\)[|]", ":?-+:?", "(#{1,6}) +", "^[-*] +"))


def _text(text: str) -> str:
    # white space at an end is kept only where that is asked for
    return f"<w:t>{text}</w:t>" if text == text.strip() else f'<w:t xml:space="preserve">{text}</w:t>'


def _cell(text: str) -> str:
    """A cell's paragraphs, which line ends part."""
    return "".join([f"<w:p><w:r>{_text(t)}</w:r></w:p>" if t else "<w:p></w:p>" for t in text.split("&lt;br&gt;")])


def _rows(lines: list[str]) -> str:
    """A table of rows, which are escaped and begin and end with |."""
    split = [[c.replace("\\|", "|").strip() for c in BAR.split(x[1:-1])] for x in lines]
    if len(split) > 1 and all(map(RULE.fullmatch, split[1])):
        del split[1]
    rows = ["</w:tc><w:tc>".join(map(_cell, r)) for r in split]
    return f"<w:tbl><w:tr><w:tc>{'</w:tc></w:tr><w:tr><w:tc>'.join(rows)}</w:tc></w:tr></w:tbl>"


def docx_package(markdown: str) -> bytes:
    """A DOCX package of simple Markdown: headings, bullets, bold, page breaks, tables and paragraphs. Lines that begin
    and end with | are a table's rows; a rule below the first row is none."""
    body, table = [], []
    for line in [*escape(markdown).split("\n"), None]:
        if line is not None and len(row := line.strip()) > 1 and row[0] == row[-1] == "|":
            table.append(row)
            continue
        if table:
            body.append(_rows(table))
            table = []
        if line is None:
            break
        if line == "\f":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
            continue
        m = HEADING.match(line)
        style = f'<w:pPr><w:pStyle w:val="Heading{len(m[1])}"/></w:pPr>' if m else ""
        line = line[m.end() :] if m else BULLET.sub("• ", line)
        runs = [f"<w:r>{'<w:rPr><w:b/></w:rPr>' * (i % 2)}{_text(t)}</w:r>" for i, t in enumerate(line.split("**")) if t]
        body.append(f"<w:p>{style}{''.join(runs)}</w:p>")
    return package_of("".join(body))


READERS = {"docx": docx_text, "udf": udf_text, "txt": lambda raw: (raw.decode("utf-8-sig"), []), "md": lambda raw: (raw.decode("utf-8-sig"), [])}


def documents(files: DataFrame) -> DataFrame:
    """(path, format, text, warnings, error) of files (path, content), as Spark's binaryFile source gives them. A file that
    cannot be read has a null text and the reason; reasons never quote the file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, kind, raw in zip(f["path"], f["format"], f["content"]):
                try:
                    if kind == "doc":
                        raise Unreadable("the old binary format; save it as docx")
                    if kind in IMAGES or kind == "pdf":
                        raise Unreadable("no text layer can be read here")
                    if kind not in READERS:
                        raise Unreadable("unsupported format")
                    text, warnings = READERS[kind](bytes(raw))
                    rows.append((path, kind, text, warnings, None))
                except Unreadable as e:
                    rows.append((path, kind, None, [], str(e)))
                except Exception as e:
                    rows.append((path, kind, None, [], type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "format", "text", "warnings", "error"])

    suffix = F.lower(F.regexp_extract("path", "[.]([A-Za-z0-9]+)$", 1))
    return files.select("path", suffix.alias("format"), "content").mapInPandas(run, "path string, format string, text string, warnings array<string>, error string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents under a folder."""
    return documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def flattened(markdown: Column) -> Column:
    """Markdown as plain text: table rules dropped, cells four spaces apart, bullets as •, no # and **."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: ~x.rlike(r"^[ ]*[|]?[ ]*:?-{2,}:?[ ]*([|][ ]*:?-{2,}:?[ ]*)*[|]?[ ]*$"))

    def line(x: Column) -> Column:
        cells = F.array_join(F.transform(F.split(F.regexp_replace(x, r"^[ ]*[|]|[|][ ]*$", ""), "[|]"), lambda c: F.trim(c)), "    ")
        plain = F.when(x.rlike(r"^[ ]*[|].*[|][ ]*$"), cells).otherwise(x)
        plain = F.regexp_replace(plain, r"^([ ]*)[-*] +", "$1• ")
        return F.regexp_replace(F.regexp_replace(plain, "^#{1,6} +", ""), "[*][*]", "")

    return F.array_join(F.transform(lines, line), "\n")
