"""Main text of web pages by composite text density.

For every node of a page's tree: its characters per tag, adjusted for how many of the characters and tags are links' (the composite density).
The node whose children's densities sum to the most is the core of the content. The least density on the way from the
page's body to the core is a threshold; beside the core, what hangs from that way belongs to the content too if it reaches the threshold and half the
density of the core. A block without a tag in it must be as dense as the core, since its whole text counts as its density. Blocks that are mostly
links are left out beside the core, and directly in it where it isn't an article.

Parts that say by their tag, role or class that they are menus, adverts, forms, notices, comments and the like are taken out beforehand, and what
names itself the article is taken whole. On pages that name nothing, density alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import in_parts, tidy, unused

#: Elements by their role in a page's structure.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
#: What never holds main text.
OUT_TAGS = frozenset("head nav aside footer form button select input label datalist output script style noscript template svg math iframe object embed canvas audio video map dialog menu search title textarea noembed noframes".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar menu menus nav navbar topnav topbar discussion discussions feedback copyright teaser teasers recommendations "
    "navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "widget widgets toolbar pagination pager skip masthead".split()
)
#: Words that keep an element in, whatever else its class says.
IN_WORDS = frozenset("article content main post entry story".split())
IN_NAMES = IN_WORDS | frozenset("body text wrap wrapper container inner area column page section block full single".split())
#: First words of names that tell of something near the element, not of the element.
TELLING = frozenset("has have no not with without is show hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An end of one of these closes no element beyond the nearest of SCOPES.
SCOPES = frozenset("html body table td th caption template".split())
CLOSED_BY = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}), "thead": frozenset({"tr", "td", "th", "tbody"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th"}),
}
LISTS = frozenset("ul ol dl menu dir table select".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|<([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "items", "out", "keep", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, keep: bool = False):
        self.tag, self.parent, self.out, self.keep = tag, parent, out, keep
        self.items: list[Node | str] = []  # children and texts in page order


def _by_name(value: str, inside_article: bool) -> tuple[bool, bool]:
    """What a class or id says, name by name: whether it leaves the element out, and whether it makes it content.

    A name of content words only (post-content, main) makes content; a name with an outside word (post-comments, main-nav) leaves out, unless
    it only tells of a neighbour (has-sidebar, no-ads).
    """
    out = keep = False
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words:
            continue
        if IN_WORDS.issuperset(words[:1]) and IN_NAMES.issuperset(words):
            keep = True
        elif words[0] not in TELLING and (not OUT_WORDS.isdisjoint(words) or ("header" in words and not inside_article)):
            out = True
    return out and not keep, keep


def _left_out(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is no main text by what it says of itself; and whether it says that it is."""
    if tag in OUT_TAGS:
        return True, False
    if tag in ("html", "body"):
        return False, False
    out = tag == "header" and not inside_article
    keep = tag in ("article", "main")
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                x, y = _by_name(value, inside_article)
                out, keep = out or x, keep or y
            elif name == "role":
                roles = set(value.lower().split())
                out |= bool(roles & OUT_ROLES)
                keep |= bool(roles & {"main", "article"})
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                out = True
    return out and tag != "main", keep and not out


class _Tree:
    """The tree under construction: the open elements, and how many there are of each tag."""

    def __init__(self):
        self.root = Node("html", None)
        self.stack = [self.root]
        self.count: dict[str, int] = {}

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = self.stack.pop()
        self.count[node.tag] -= 1
        return node

    def close(self, tags: frozenset, stop: frozenset, all_of_them: bool = False) -> bool:
        """Close the nearest open element of these tags, or the farthest, with what is open inside it; none beyond an element of stop."""
        if not any(self.count.get(t) for t in tags):
            return False
        found = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                found = i
                if not all_of_them:
                    break
            elif self.stack[i].tag in stop:
                break
        while found and len(self.stack) > found:
            self.pop()
        return bool(found)


_P = frozenset({"p"})


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are taken as browsers take them, as far as text blocks are concerned."""
    tree, at, n, in_body = _Tree(), 0, len(page), False
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            tree.here.items.append(unescape(page[at:]))
            break
        if m.start() > at:
            tree.here.items.append(unescape(page[at : m.start()]))
        at = m.end()
        name = m[1] or m[2] or m[4]
        tag = name.lower() if name else ""
        if not tag:
            if m[0].startswith("<![CDATA["):
                tree.here.items.append(m[0][9:].removesuffix("]]>"))
        elif tag == "br":
            tree.here.items.append(" ")
        elif m[1]:
            if tag not in ("html", "body"):
                tree.close(frozenset({tag}), SCOPES - {tag})
        elif tag == "html":
            pass
        elif tag == "body":
            if not in_body:
                in_body = True
                while len(tree.stack) > 1:
                    tree.pop()
                body = Node("body", tree.root)
                tree.root.items.append(body)
                tree.push(body)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        else:
            attributes = m[3] if m[2] else m[5]
            if tag in BLOCKS:
                tree.close(_P, SCOPES)
            if tag in CLOSED_BY:
                tree.close(CLOSED_BY[tag], LISTS, all_of_them=True)
            inside = bool(tree.count.get("article") or tree.count.get("main"))
            node = Node(tag, tree.here, *_left_out(tag, attributes, inside))
            tree.here.items.append(node)
            if tag not in VOID:
                tree.push(node)
    return tree.root


def _measured(root: Node) -> list[Node]:
    """Fill in the figures of all nodes that are left in; returns them, each before its children."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [y for y in x.items if isinstance(y, Node) and not y.out]
    for x in reversed(order):
        own = sum(len(" ".join(y.split())) for y in x.items if isinstance(y, str))
        inner = [y for y in x.items if isinstance(y, Node) and not y.out]
        x.chars = own + sum(y.chars for y in inner)
        x.tags = sum(y.tags + 1 for y in inner)
        link = x.tag == "a"
        x.link_chars = x.chars if link else sum(y.link_chars for y in inner)
        x.link_tags = x.tags if link else sum(y.link_tags + (y.tag == "a") for y in inner)
    whole = order[0]
    ratio = whole.link_chars / max(whole.chars, 1)
    for x in reversed(order):
        if x.chars == 0:
            x.density = 0.0
        else:
            tags, links, link_tags = max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
            base = log(x.chars / max(x.chars - x.link_chars, 1) * x.link_chars + ratio * x.chars + e)
            x.density = x.chars / tags * max(log(x.chars / links * tags / link_tags), 0.0) / base
            if x.tags == 0 and x.link_chars == 0:
                x.density = x.chars * max(log(x.chars), 1.0) / base
        x.total = sum(y.density for y in x.items if isinstance(y, Node) and not y.out)
    return order


def _without_link_lists(x: Node) -> list[Node | str]:
    """What is in x, without the blocks that are mostly links: directly in it, those are menus. In an html element, the same of its body."""
    if x.tag == "html":
        return [z for y in x.items for z in (_without_link_lists(y) if isinstance(y, Node) and y.tag == "body" else [y])]
    return [y for y in x.items if isinstance(y, str) or y.tag not in BLOCKS or y.tag in HEADINGS or y.out or 2 * y.link_chars <= y.chars]


def _chosen(root: Node) -> list[Node | str]:
    """The parts of the tree that make up the content, in page order."""
    order = _measured(root)
    if not order[0].chars:
        return []
    core = max(order, key=lambda x: x.total)
    if core.total <= 0:
        core = max(order, key=lambda x: x.density)
    # A paragraph is no core: its block's siblings are of its kind. And what names itself the article is taken whole.
    while core.parent is not None and (core.tag not in BLOCKS or core.tag in ("p", "li", "tr", "td", "tbody", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6")):
        core = core.parent
    x, lifted = core, core
    while x is not None:
        if x.tag in ("article", "main") or (x.keep and x.tag not in ("body", "html")):
            lifted = x
            if x.tag == "article":
                break
        x = x.parent
    core = lifted
    way = [core]
    while way[-1].parent is not None:
        way.append(way[-1].parent)
    threshold = min((x.density for x in way if x.tag != "html"), default=0.0)
    if core.tag == "article" and core.parent is not None:
        # Articles beside it that are as dense are the rest of the text.
        return [x for x in core.parent.items if x is core or isinstance(x, Node) and x.tag == "article" and not x.out and 2 * x.link_chars <= x.chars and x.density >= threshold]
    if core.tag in ("article", "main"):
        return [core]
    if core.keep:
        # Named content without the element for it.
        return _without_link_lists(core)
    if core.tag in ("html", "body"):
        # No block stands out: all of the body but its lists of links.
        return _without_link_lists(core)
    on_way, parts, stack = set(map(id, way)), [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x is core:
            parts.append(x)
        elif id(x) in on_way:
            # Breaks keep the texts of different blocks apart.
            stack += ["\0", *reversed(x.items), "\0"]
        elif not x.out and 2 * x.link_chars <= x.chars and (x.tag in HEADINGS or x.density >= max(threshold, core.density if x.tags == 0 else core.density / 2)):
            parts.append(x)
    return parts


def extract(page: str | None) -> str:
    """The main text: its blocks in page order, joined by an empty line; white space in a block is one space. Empty for null, for pages without text, and where all text is left out."""
    if not page:
        return ""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    stack: list = [*reversed(_chosen(parse(page)))]
    while stack:
        x = stack.pop()
        if x is None or x == "\0":
            close()
        elif isinstance(x, str):
            run.append(x)
        elif not x.out:
            if x.tag in BLOCKS:
                close()
                stack.append(None)
            stack += reversed(x.items)
    close()
    return "\n\n".join(blocks)


def extracted(df: DataFrame, html_col: str = "html", out_col: str = "text", *kept: str) -> DataFrame:
    """The columns `kept` of df, with the main text and its length in code points (out_col, n_chars). One row for each row; kept columns called out_col or n_chars give way."""
    (source,) = unused(df, "_html")
    names = [c for c in kept if c.lower() not in (out_col.lower(), "n_chars")]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 0):
                texts = [extract(x.as_py()) for x in part.column(0)]
                new = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=[*part.schema.names[1:], out_col, "n_chars"])

    slim = df.select(F.col(html_col).cast("string").alias(source), *(F.col(f"`{c}`") for c in names))
    schema = StructType([*slim.drop(source).schema.fields, StructField(out_col, StringType()), StructField("n_chars", LongType())])
    return slim.mapInArrow(work, schema)
