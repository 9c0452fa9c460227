"""Main text of web pages by removing each site's template.

A page is cut into tags and text by one regular expression (scripts and styles are taken whole) and read as
a tree, once. Two kinds of subtrees go:

* *templates*: every container's subtree (names, classes, text) is hashed, Spark counts on how many
  different pages of a host each hash occurs, and those on at least ``LEAST_PAGES`` are its templates, at every
  size of the host. Pages with the same article count once, so copies of an article make no template of its
  parts. Inside an article only boxes (``BOXES``) can be templates, never its own paragraphs, headings and
  lists; outside, everything can;
* parts that say what they are: by element (``FURNITURE``), role, or class and id. Outside an article one word
  of ``HINTS`` in a name is enough; inside, a whole name has to say it (``PLAIN`` and ``NEUTRAL`` words only), so
  that "related-work", "search-result" or "discussion" are text.

What is left of the page's articles (or ``main``, or else of its body) is its text: character references
decoded, white space inside a block one space, blocks joined by one space in page order.

The first pass stores each page's hashes with its text or, where boxes are part of the text, its pieces and the
box of each. Counts run over (host, hash, article) rows, so a host with a third of all pages is spread by its
hashes. Only pages with such boxes meet templates, as (page, host, hash) rows salted by page; what
comes back to a page are those of its own boxes, so no list grows with its host, and no html is shuffled.

Defined cases: null or empty html has no text; a null or unreadable URL is a host of its own name (empty);
unclosed and misnested tags close where their parents do; repeated rows get a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.arrow import slices, stored

LEAST_PAGES = 5
#: Parts that the pages of one host are dealt to when they meet its templates.
SALTS = 16

RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no part of an article's text.
FURNITURE = frozenset(
    "head nav header footer aside form button select option fieldset dialog menu svg canvas object audio video map".split()
) | frozenset(RAW)
#: Words of a class, id or role that name such parts.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay sidebar menu nav
    navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager share sharing social related
    recommended recommendations trending comment comments respond disqus replies discussion widget search
    contentinfo complementary dialog""".split()
)
#: Words that name such parts inside an article, too, alone or with neutral words.
PLAIN = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    notice notices newsletter subscribe subscription signup login popup modal overlay sidebar menu nav navbar navigation
    breadcrumb breadcrumbs footer masthead toolbar pagination pager share sharing comment comments respond disqus
    replies contentinfo complementary""".split()
)
NEUTRAL = frozenset(
    """area bar block body box button buttons card container content form group icons inner item items left link links
    list main panel right row section slot thread top bottom unit wrap wrapper""".split()
)
BOXES = frozenset("div section aside nav header footer form details figure table menu".split())
ROOTS = frozenset(("article", "main"))
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
#: A start tag of the first kind ends an open element of the second.
IMPLIED = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
_ENDS_P = BLOCKS - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "legend", "summary"}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b([^>]*)>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:\b(?:class|id|role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden\b|aria-hidden\s*=\s*[\"']?true)", re.I)
_WORD = re.compile(r"[a-z]+")


def _plain(words: list[str]) -> bool:
    return any(w in PLAIN for w in words) and all(w in PLAIN or w in NEUTRAL for w in words)


#: The edge of a block between pieces of text; a page's own characters of this kind are edges, too.
EDGE = "\x1e"
_MADE = {
    "article": pa.int64(),
    "keys": pa.list_(pa.int64()),
    "text": pa.string(),
    "boxes": pa.list_(pa.struct([("key", pa.int64()), ("around", pa.int32())])),
    "pieces": pa.list_(pa.struct([("text", pa.string()), ("box", pa.int32())])),
}
_READ = """page_id long, url string, host string, article long, keys array<long>, text string,
    boxes array<struct<key: long, around: int>>, pieces array<struct<text: string, box: int>>"""


class Node:
    __slots__ = ("name", "names", "parts", "furniture")

    def __init__(self, name: str, attributes: str = "", inside: bool = False):
        self.name = name
        self.names = tuple("".join(m) for m in _NAMED.findall(attributes)) if attributes else ()
        self.parts: list[Node | str] = []
        if inside:
            hinted = any(_plain(_WORD.findall(one)) for n in self.names for one in n.lower().split())
        else:
            hinted = any(w in HINTS for n in self.names for w in _WORD.findall(n.lower()))
        self.furniture = name in FURNITURE or bool(hinted and name not in ("html", "body", "main", "article"))
        if attributes and not self.furniture and _HIDDEN.search(attributes):
            self.furniture = True
        if hinted and name == "article" and any("comment" in n.lower() for n in self.names):
            self.furniture = True


def parse(page: str) -> Node:
    """The tree of a page; raw elements hold no text."""
    root = Node("")
    path = [root]
    opened: Counter[str] = Counter()  # how often each name is in the path

    def close(at: int) -> None:
        opened.subtract(n.name for n in path[at:])
        del path[at:]

    for m in _TOKEN.finditer(page):
        raw, name = m.group(1), m.group(5)
        if raw:
            path[-1].parts.append(Node(raw.lower(), m.group(2)))
        elif name:
            name = name.lower()
            if m.group(4):
                at = next((i for i in range(len(path) - 1, 0, -1) if path[i].name == name), 0) if opened[name] else 0
                # An end tag that would close an article around it by mistake closes nothing.
                if at and not (name not in ROOTS and any(opened[r] for r in ROOTS) and any(n.name in ROOTS for n in path[at + 1 :])):
                    close(at)
                continue
            if name in _ENDS_P and path[-1].name != "p" and opened["p"]:
                inline = next((i for i in range(len(path) - 1, 0, -1) if path[i].name in BLOCKS), 0)
                if inline and path[inline].name == "p":
                    close(inline)
            elif name in _ENDS_P and path[-1].name == "p":
                close(len(path) - 1)
            if path[-1].name in IMPLIED.get(name, ()):
                close(len(path) - 1)
                if name == "tr" and path[-1].name == "tr":
                    close(len(path) - 1)
            node = Node(name, m.group(6), any(opened[r] for r in ROOTS))
            path[-1].parts.append(node)
            if name not in VOID and not m.group(6).endswith("/"):
                path.append(node)
                opened[name] += 1
        elif not m.group().startswith(("<!", "<?")):
            path[-1].parts.append(m.group())
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool, bool]]:
    """All nodes children first: (node, inside an article, inside furniture or such itself)."""
    stack = [(root, False, False, False)]
    while stack:
        node, article, furniture, done = stack.pop()
        if done:
            yield node, article, furniture
            continue
        stack.append((node, article, furniture, True))
        inner, within = furniture or node.furniture, article or node.name in ROOTS
        stack.extend((p, within, inner, False) for p in node.parts if isinstance(p, Node))


def hashes(root: Node) -> dict[int, int]:
    """Hash of every subtree by the identity of its node."""
    found: dict[int, int] = {}
    for node, _, _ in _walk(root):
        parts = [p.strip() if isinstance(p, str) else str(found[id(p)]) for p in node.parts]
        text = "\x1f".join([node.name, *node.names, *(p for p in parts if p)])
        found[id(node)] = xxhash.xxh64_intdigest(text) - (1 << 63)
    return found


def candidates(root: Node) -> tuple[list[tuple[Node, bool]], Node | None]:
    """Nodes that may be templates, and the first article outside furniture."""
    found, first = [], None
    for node, article, furniture in _walk(root):
        if not furniture and not node.furniture and node.name in ROOTS and not article:
            first = first or node
        if node.name and (node.name in BOXES if article else node.name not in ("html", "body", *ROOTS)):
            found.append((node, article))
    return found, first


def cut(root: Node, named: dict[int, int]) -> tuple[list[tuple[int, int]], list[tuple[str, int]]]:
    """The page's main text in pieces: ((hash, enclosing box) of each box, (text, innermost box) of each piece).

    A box is a part of the text that goes where its hash is a template's; -1 stands for no box. Boxes come after
    those around them, and an edge of a block is a piece ``EDGE``.
    """
    roots: list[Node] = []
    body = None
    stack = [root]
    while stack:  # outermost articles outside furniture, in page order
        node = stack.pop()
        if node.name == "body" and body is None:
            body = node
        if node.furniture:
            continue
        if node.name in ROOTS:
            roots.append(node)
        else:
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    tops = roots or [body or root]
    outer = {id(n) for n in tops}
    boxes: list[tuple[int, int]] = []
    pieces: list[tuple[str, int]] = []
    pending: list[tuple[Node | str, int]] = [(n, -1) for n in reversed(tops)]
    while pending:
        part, box = pending.pop()
        if isinstance(part, str):
            if pieces and pieces[-1][1] == box:
                pieces[-1] = pieces[-1][0] + part, box
            else:
                pieces.append((part, box))
            continue
        if part.furniture or part.name == "title":
            continue
        if id(part) not in outer and (part.name in BOXES if roots else part.name not in ("html", "body", *ROOTS)):
            boxes.append((named[id(part)], box))
            box = len(boxes) - 1
        edge = [(EDGE, box)] if part.name in BLOCKS else []
        pending.extend(edge)
        pending.extend((p, box) for p in reversed(part.parts))
        pending.extend(edge)
    return boxes, pieces


def joined(boxes: list[tuple[int, int]], pieces: list[tuple[str, int]], gone: frozenset[int]) -> str:
    """The text of the pieces outside boxes whose hash is in ``gone``."""
    dropped: list[bool] = []
    for key, around in boxes:
        dropped.append(key in gone or (around >= 0 and dropped[around]))
    blocks = "".join(text for text, box in pieces if box < 0 or not dropped[box]).split(EDGE)
    return " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        made: dict[str, list] = {name: [] for name in ("article", "keys", "text", "boxes", "pieces")}
        for page in part["html"].to_pylist():
            root = parse(page or "")
            named = hashes(root)
            nodes, first = candidates(root)
            made["article"].append(named[id(first)] if first else named[id(root)])
            made["keys"].append(list({named[id(n)] for n, _ in nodes}))
            boxes, pieces = cut(root, named)
            made["text"].append(None if boxes else joined(boxes, pieces, frozenset()))
            made["boxes"].append([{"key": k, "around": a} for k, a in boxes] if boxes else None)
            made["pieces"].append([{"text": t, "box": b} for t, b in pieces] if boxes else None)
        columns = [pa.array(made[name], kind) for name, kind in _MADE.items()]
        yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], part["host"], *columns], ["page_id", "url", "host", *_MADE])


def _assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            text = [
                joined([(b["key"], b["around"]) for b in boxes], [(p["text"], p["box"]) for p in pieces], frozenset(gone or ()))
                for boxes, pieces, gone in zip(part["boxes"].to_pylist(), part["pieces"].to_pylist(), part["gone"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(text, pa.string())], ["page_id", "url", "text"])


def _hosted(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )


def templates(read: DataFrame) -> DataFrame:
    """(host, key): the hashes of each host's template subtrees, from rows of host, article and keys."""
    rows = read.select("host", "article", F.explode("keys").alias("key")).distinct()
    return rows.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", "key")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    read = _hosted(pages).mapInArrow(_read, _READ).withColumn("row", F.monotonically_increasing_id())
    read = stored(read, "pages")
    boxed = read.filter(F.col("boxes").isNotNull())
    own = boxed.select("row", "host", (F.col("row") % SALTS).alias("salt"), F.explode(F.array_distinct("boxes.key")).alias("key"))
    known = templates(read).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    gone = own.join(known, ["host", "salt", "key"]).groupBy("row").agg(F.collect_list("key").alias("gone"))
    mixed = boxed.select("row", "page_id", "url", "boxes", "pieces").join(gone, "row", "left").drop("row")
    text = mixed.mapInArrow(_assembled, "page_id long, url string, text string")
    return read.filter(F.col("boxes").isNull()).select("page_id", "url", "text").unionByName(text)
