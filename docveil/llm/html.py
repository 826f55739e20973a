"""Main text of web pages by site template removal.

Every element subtree is hashed twice: with its text, and as a skeleton of tags, classes and links at its place in the page, in
which runs of like children are one. Spark counts both by host. A subtree whose text recurs across many pages of its host is
template, wherever it is; one whose skeleton recurs is, outside of the host's content, if it is mostly links or holds little
of its pages' text. The content is the deepest place that holds most of the host's text. Pages with the same prose count once
for a subtree of prose: what recurs with always the same rest is a copied article, not a site's template.

Elements that say by tag, role or class that they are no article go as well (`declared`); on hosts with fewer than LEAST_PAGES
pages these are all there is to go by. Of what is left, declared articles are the text unless there is more prose outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.llm.common import staged, table

#: A subtree recurs if it is on at least this many pages of its host, and on this share of them.
LEAST_PAGES = 3
LEAST_SHARE = 0.3
#: The content holds this share of its host's text, in about one element a page.
CONTENT_SHARE, CONTENT_TIMES = 0.5, 1.2
#: A recurring skeleton is template if it holds at most this share of the text of the pages that have it.
LITTLE = 0.1
#: Tables of up to so many hosts with templates are sent to all executors; larger ones meet pages in SALTS groups a host.
SMALL, SALTS = 20_000, 32
#: What is counted: subtrees by text, subtrees by skeleton, places.
TEXT, SKELETON, PLACE = 0, 1, 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title)\b(?:[^\"'>]++|\"[^\"]*\"|'[^']*'|[\"'])*?>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<own>svg|iframe|object)\b(?:[^\"'>/]++|/(?!>)|\"[^\"]*\"|'[^']*'|[\"'])*?>.*?(?:</(?P=own)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end separate blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements of the head and of forms, which hold no text of a page.
NEVER = frozenset("head form button select dialog audio video canvas map fieldset".split())
#: Elements that declare that they are never part of an article.
DROPPED = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of a class or id that mark what is no article; a word of WEAK does so inside of an article only for what is mostly links.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager masthead topbar footer comment comments commentlist disqus respond replies hidden outbrain taboola".split()
)
WEAK = frozenset("alert share sharing social related recommended recommendations login search toolbar skip".split())
#: Words that mark even an <article> as a reader's.
READERS = frozenset("comment comments reply replies".split())
#: Words that say where or what kind of box a marked element is; a name of other words besides (`with-sidebar`) marks nothing.
BESIDE = frozenset(
    "area bar block bottom box button buttons col column container content fixed float global group holder icons inner item items left link links list main outer "
    "panel post posts primary right row secondary section side site slot sticky text top unit wrap wrapper".split()
)
#: A declared element that holds more than this share of the page's unlinked text is the page, unless it is readers'.
MOST = 0.75
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
TOP = 1 << 63


@dataclass
class Node:
    tag: str
    dropped: bool
    weak: bool
    article: bool
    first: int
    block: int  # where on the stack the nearest block element is
    label: str = ""
    place: int = 0
    depth: int = 0
    inside: bool = False  # of a declared article or main
    parts: list[bytes] = field(default_factory=list)
    bones: list[bytes] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    begin: int = -1  # where the element begins, or the dropped one that it is in


@dataclass
class Page:
    """Blocks of text, which of them are in a declared article, how much of each is not links; subtrees (text hash, skeleton,
    place, first block, end); and what is counted: (kind, hash) to [elements, size, linked, depth, prose]."""

    blocks: list[str] = field(default_factory=list)
    articles: list[bool] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)
    subtrees: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    counts: dict[tuple[int, int], list] = field(default_factory=dict)
    size: int = 0

    def count(self, kind: int, key: int, size: int, linked: int, depth: int, prose: bool) -> None:
        c = self.counts.setdefault((kind, key), [0, 0, 0, depth, prose])
        c[0] += 1
        c[1] += size
        c[2] += linked

    def body(self) -> int:
        """A hash of the page's blocks that are not mostly links."""
        return _hash("\0".join(b for b, n in zip(self.blocks, self.plain) if 2 * n > len(b)).encode("utf-8", "surrogatepass"))


def _hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - TOP


def attributes(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), next(filter(None, values), "").lower()) for name, *values in ATTRIBUTE.findall(attrs)]


def marked(tag: str, attrs: list[tuple[str, str]], inside: bool) -> str:
    """Whether an element says that it is no article: "yes", "weak" (if it is mostly links) or "". Inside of an article a header
    belongs to it."""
    if tag in DROPPED or tag == "header" and not inside:
        return "yes"
    if tag in ("html", "body"):
        return ""
    found = ""
    for name, value in attrs:
        if name in ("class", "id"):
            for one in value.split():
                words = WORDS.findall(one)
                marks = [w for w in words if w not in BESIDE]
                if tag in ("article", "main"):
                    if marks and READERS.issuperset(marks):
                        return "yes"
                elif not marks:
                    continue
                elif MARKS.issuperset(marks) or not inside and MARKS.union(("header",)).issuperset(marks):
                    return "yes"
                elif MARKS.union(WEAK).issuperset(marks):
                    found = "weak" if inside else "yes"
        elif tag not in ("article", "main"):
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return "yes"
            if name == "style" and "display:none" in value.replace(" ", ""):
                return "yes"
    return found


def kept_out(attrs: list[tuple[str, str]]) -> bool:
    """Readers' comments and what is not shown go, however much of a page they are."""
    for name, value in attrs:
        if name in ("class", "id") and not READERS.isdisjoint(WORDS.findall(value)) or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def parse(html: str, declared: bool = True) -> Page:
    """A page's blocks and subtrees outside of dropped elements. Unclosed elements end with those around them. An element that
    is to be dropped but holds MOST of the page's unlinked text is not."""
    spared: set[int] = set()
    while True:
        page, dropped = _parse(html, declared, spared)
        whole = sum(page.plain) + sum(dropped.values())
        if not (more := {i for i, n in dropped.items() if n > MOST * whole}):
            return page
        spared |= more


def _parse(html: str, declared: bool, spared: set[int]) -> tuple[Page, dict[int, int]]:
    """The page, and of elements that could be spared (by where they begin) how much unlinked text they hold."""
    page, text, links, plain, dropped = Page(), [], 0, 0, {}
    stack = [Node("", False, False, False, 0, 0)]
    open_: dict[str, int] = {}

    def flush() -> None:
        nonlocal text, plain
        if text:
            block = SPACE.sub(" ", unescape("".join(text))).strip()
            if block:
                page.blocks.append(block)
                page.articles.append(stack[-1].article)
                page.plain.append(plain)
            text, plain = [], 0

    def close() -> None:
        nonlocal links
        node, top = stack.pop(), stack[-1]
        open_[node.tag] -= 1
        if node.tag == "a":
            links = 0
        if not node.size or node.dropped:
            return
        if node.weak and 2 * node.linked >= node.size:
            del page.blocks[node.first :], page.articles[node.first :], page.plain[node.first :]
            page.subtrees[:] = [s for s in page.subtrees if s[3] < node.first]
            return
        digest = _hash(node.tag.encode() + b"\0" + b"\1".join(node.parts))
        top.parts.append(digest.to_bytes(8, "little", signed=True))
        top.size += node.size
        top.linked += node.linked
        if node.tag not in BLOCK:  # inline elements are bones of what they stand in
            bones = [b"a"] if node.tag == "a" else node.bones
        else:
            bones = [xxhash.xxh3_64_digest(node.label.encode("utf-8", "surrogatepass") + b"\0" + b"\1".join(node.bones))]
            skeleton = _hash(node.place.to_bytes(8, "little", signed=True) + bones[0])
            page.subtrees.append((digest, skeleton, node.place, node.first, len(page.blocks)))
            prose = 2 * node.linked < node.size
            page.count(TEXT, digest, node.size, node.linked, 0, prose)
            if node.tag not in HEADINGS:
                page.count(SKELETON, skeleton, node.size, node.linked, 0, prose)
            if not (declared and node.inside):
                page.count(PLACE, node.place, node.size, node.linked, node.depth, prose)
        for b in bones:
            if not top.bones or top.bones[-1] != b:
                top.bones.append(b)

    def say(raw: str) -> None:
        nonlocal plain
        top = stack[-1]
        if raw and top.dropped:
            if top.begin in dropped and not links:
                dropped[top.begin] += len(SPACE.sub(" ", raw).strip())
        elif raw:
            text.append(raw)
            shown = SPACE.sub(" ", raw).strip()
            if shown:
                top.parts.append(shown.encode("utf-8", "surrogatepass"))
                if not top.bones or top.bones[-1] != b"#":
                    top.bones.append(b"#")
                top.size += len(shown)
                top.linked += len(shown) if links else 0
                plain += 0 if links else len(shown)

    at = 0
    for m in TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, end, raw = tag.lower(), m["end"] or m["end2"], m["attrs"] or ""
        if tag in BLOCK:
            flush()
        elif tag == "br" and not stack[-1].dropped:
            text.append(" ")
        if end:
            if open_.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:  # a paragraph ends where a block starts, a list's or table's part where the next one starts
            k = stack[-1].block
            if k and (stack[k].tag == "p" or stack[k].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                while len(stack) > k:
                    close()
        top = stack[-1]
        attrs = attributes(raw) if raw and raw.strip(" /") else []
        article = top.article or tag in ("article", "main")
        mark = marked(tag, attrs, article) if declared and not top.dropped else ""
        if mark == "weak" and tag not in BLOCK:
            mark = ""
        drop = (tag in NEVER or mark == "yes") and m.start() not in spared
        node = Node(tag, top.dropped or drop, mark == "weak", article, len(page.blocks), top.block, place=top.place, depth=top.depth, inside=top.article)
        if tag in BLOCK:
            node.block = len(stack)
            if not node.dropped:
                classes = sorted({w for name, value in attrs if name == "class" for w in WORDS.findall(value)})
                node.label = ".".join([tag, *classes])
                node.place, node.depth = _hash(top.place.to_bytes(8, "little", signed=True) + node.label.encode("utf-8", "surrogatepass")), top.depth + 1
        node.begin = top.begin if top.dropped else m.start()
        if drop and not top.dropped and tag != "head" and not kept_out(attrs):
            dropped[node.begin] = 0
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
        if tag == "a":
            links = 1
    say(html[at:])
    flush()
    while len(stack) > 1:
        close()
    page.size = stack[0].size
    return page, dropped


def main_text(page: Page, texts: set[int] = frozenset(), skeletons: set[int] = frozenset(), content: int | None = None, articles: bool = True) -> str:
    """The blocks outside of template subtrees: those of the page's articles, or all if there is more prose outside of these
    (or without `articles`). Skeletons do not count within the content's place."""
    gone: set[int] = set()
    bare: set[int] = set()
    kept: set[int] = set()
    for digest, skeleton, place, first, end in page.subtrees:
        if digest in texts:
            gone.update(range(first, end))
        if skeleton in skeletons:
            bare.update(range(first, end))
        if place == content:
            kept.update(range(first, end))
    gone |= bare - kept
    left = [i for i in range(len(page.blocks)) if i not in gone]
    inside = [i for i in left if page.articles[i]] if articles else left
    prose = sum(page.plain[i] for i in inside)
    if not inside or 2 * prose < sum(page.plain[i] for i in left):
        inside = left
    return "\n\n".join(page.blocks[i] for i in inside)


def host(url: str = "url") -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, with A-Z in lower case; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


COUNT = "struct<kind:tinyint,hash:bigint,elements:int,size:int,linked:int,depth:int,prose:boolean>"
SUBTREE = "struct<text:bigint,skeleton:bigint,place:bigint,first:int,end:int>"
PARSED = f"blocks array<string>, articles array<boolean>, plain array<int>, subtrees array<{SUBTREE}>, counts array<{COUNT}>, body bigint, size int"


def parsed(pages: DataFrame, declared: bool = True) -> DataFrame:
    """pages (page_id, url, html), each parsed once, as (page_id, url, host, blocks, articles, plain, subtrees, counts, body, size)."""
    rows = pages.select("page_id", "url", host().alias("host"), "html")
    subtree = pa.struct([("text", pa.int64()), ("skeleton", pa.int64()), ("place", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
    count = pa.struct([("kind", pa.int8()), ("hash", pa.int64()), ("elements", pa.int32()), ("size", pa.int32()), ("linked", pa.int32()), ("depth", pa.int32()), ("prose", pa.bool_())])

    def structs(lists: list[list[tuple]], kind: pa.StructType) -> pa.Array:
        ends, flat = [0], []
        for one in lists:
            flat += one
            ends.append(len(flat))
        columns = zip(*flat) if flat else [()] * kind.num_fields
        fields = [pa.array(c, kind.field(i).type) for i, c in enumerate(columns)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=[kind.field(i) for i in range(kind.num_fields)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [parse(h or "", declared) for h in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(3)),
                        pa.array([p.blocks for p in found], pa.list_(pa.string())),
                        pa.array([p.articles for p in found], pa.list_(pa.bool_())),
                        pa.array([p.plain for p in found], pa.list_(pa.int32())),
                        structs([p.subtrees for p in found], subtree),
                        structs([[(*k, *c) for k, c in p.counts.items()] for p in found], count),
                        pa.array([p.body() for p in found], pa.int64()),
                        pa.array([p.size for p in found], pa.int32()),
                    ],
                    names=["page_id", "url", "host", "blocks", "articles", "plain", "subtrees", "counts", "body", "size"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, {PARSED}")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, texts array<bigint>, skeletons array<bigint>, content bigint) of hosts with templates, from parsed pages.

    A host has at most 1 / least_share as many of each as its pages have subtrees on average.
    """
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("host_size")).where(F.col("pages") >= least_pages)
    # copied pages count once for prose
    bodies = pages.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("bodies"))
    rows = pages.select("host", "body", F.col("size").alias("page_size"), F.inline("counts"))
    by_body = rows.groupBy("host", "kind", "hash", "prose", F.when((F.col("kind") == TEXT) & F.col("prose"), F.col("body")).alias("body")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("elements").alias("elements"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.sum("page_size").alias("around"), F.max("depth").alias("depth")
    )
    # a skeleton or a place is one, whether its text is prose or not
    prose = (F.col("kind") == TEXT) & F.col("prose")
    counted = by_body.groupBy("host", "kind", "hash", prose.alias("prose")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.sum("elements").alias("elements"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.sum("around").alias("around"), F.max("depth").alias("depth")
    )
    known = counted.join(sizes, "host").join(bodies, "host")
    n, of = F.when(F.col("prose"), F.col("copies")).otherwise(F.col("n")), F.when(F.col("prose"), F.col("bodies")).otherwise(F.col("pages"))
    known = staged(known.where((n >= least_pages) & (n >= of * least_share)), "recurring")
    most = known.where((F.col("kind") == PLACE) & (F.col("size") >= F.col("host_size") * CONTENT_SHARE) & (F.col("elements") <= F.col("n") * CONTENT_TIMES))
    content = most.groupBy("host").agg(F.max_by("hash", F.struct("depth", "size", "hash")).alias("content"))
    links, little = 2 * F.col("linked") >= F.col("size"), F.col("content").isNotNull() & (F.col("size") <= F.col("around") * LITTLE)
    return (
        known.join(content, "host", "left")
        .groupBy("host", "content")
        .agg(F.collect_set(F.when(F.col("kind") == TEXT, F.col("hash"))).alias("texts"), F.collect_set(F.when((F.col("kind") == SKELETON) & (links | little), F.col("hash"))).alias("skeletons"))
        .select("host", "texts", "skeletons", "content")
    )


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, declared: bool = True) -> DataFrame:
    """(page_id, url, text) of every page (page_id, url, html); rows that repeat an id, or have none, are pages of their own.

    Null or empty html gives an empty text; a null url has host ''. Blocks are separated by two line ends; character
    references are decoded; white space in a block is one space. Without `declared`, only the templates decide.
    """
    once = staged(parsed(pages, declared), "parsed", "zstd")
    of_host = staged(templates(once, least_pages, least_share), "templates")
    rows = once.select("page_id", "url", "host", "blocks", "articles", "plain", "subtrees")
    if of_host.count() <= SMALL:
        met = rows.join(F.broadcast(of_host), "host", "left")
    else:  # a host's pages meet its templates in several groups
        salted = of_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("__salt", F.pmod(F.xxhash64("blocks"), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for blocks, articles, plain, subtrees, texts, skeletons, content in zip(*(part.column(i).to_pylist() for i in range(2, 9))):
                    page = Page(blocks, articles, plain, [(s["text"], s["skeleton"], s["place"], s["first"], s["end"]) for s in subtrees])
                    out.append(main_text(page, set(texts or ()), set(skeletons or ()), content, declared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    wanted = met.select("page_id", "url", "blocks", "articles", "plain", "subtrees", "texts", "skeletons", "content")
    return wanted.mapInArrow(run, f"page_id {kind}, url string, text string")


def op1(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
