"""HTML extraction by tree scoring.

A page is read into a tree; each paragraph-like block gives points for its length and commas to
its parent and, halved, to its grandparent, discounted by the share of its text in links. The
best-scoring container is widened to the article (or main, or section of sibling parts) around it,
and all of that is kept in page order, with those siblings that are not mostly links. Page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) is left out before scoring, by tag, role, or words of class and id.

Defined results: null, empty or tag-less input gives its plain text or the empty string; unclosed
and misnested tags are closed as browsers do for paragraphs and list items; end tags without a start
are ignored; a quote counts only at the head of an attribute's value; a page cut off in a tag loses
that tag; pages are independent rows, repeated rows repeat; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Quotes count only where a value begins; a quote that is never closed is part of an unquoted value.
TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))
    |(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+)*+)(>|\Z)|\Z)""",
    re.S | re.X,
)
ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
UNQUOTED = re.compile(r"""=\s*[^\s"'>][^\s>]*\Z""")
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button select input textarea label fieldset script style noscript template iframe svg math object canvas audio video dialog menu head title legend option".split())
# Words of class and id that mark page furniture, those of reader comments, and what such words are joined with.
UNLIKELY_WORDS = r"ads? advert\w* adbox adslot adunit adsbygoogle adsense banner breadcrumbs? consent cookies? foot footer gdpr header login masthead menu modal nav navbar navigation newsletter notices? notification overlay pager pagination popup promo\w* recommend\w* related rss search share sharing shoutbox sidebar signup skip social sponsor\w* subscribe toolbar topbar tweet widget"
COMMENT_WORDS = r"comments? commenters? discussion disqus replies reply respond responses?"
JOINED_WORDS = r"area articles? bar block body bottom box btn buttons? container content entry fixed form global group holder icons? inner items? left link links list main media module notice outer page panel popup post posts primary region right row secondary section site slot sticky stories text title top unit widget wrap wrapper \d+"
_PART = {name: re.compile("|".join(words.split()), re.I) for name, words in (("page", UNLIKELY_WORDS), ("comment", COMMENT_WORDS), ("joined", JOINED_WORDS))}


def furniture(names: str) -> str:
    """``comment`` or ``page`` where a name of class or id is such a word, or joins one with nothing but such words
    and the usual affixes; else empty."""
    found = set()
    for name in names.split():
        kinds = set()
        for part in filter(None, re.split("[_-]", name.replace("side-bar", "sidebar"))):
            kinds.add(next((k for k in ("comment", "page", "joined") if _PART[k].fullmatch(part)), ""))
        found |= kinds if "" not in kinds else set()
    return "comment" if "comment" in found else "page" if "page" in found else ""


#: Inside an article these elements carry text: a furniture word alone drops none of them, links must bear it out;
#: a section must also be short.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table dl dt dd li".split())
SHORT_SECTION = 200
LIKELY = re.compile(rf"(?:^|[\s_-])(?:{UNLIKELY_WORDS.replace(' ', '|')})(?:$|[\s_-])", re.I)
LIKELY = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
#: Raw elements whose content browsers never read as markup, even where no end tag follows.
SWALLOWS = RAW - {"template", "noscript", "svg", "math"}
SCORED = frozenset("p pre td blockquote li dd div section article h2 h3".split())
#: A part of the page with this share of its text in links is no text.
MOST_LINKS = 0.25
CLOSES = {"p": BLOCK - {"caption", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class Node:
    __slots__ = ("tag", "names", "role", "parent", "children", "score", "off", "doubtful")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", in_article: bool = False):
        self.tag, self.parent, self.children, self.score = tag, parent, [], 0.0
        found: dict[str, str] = {}
        for k, v in ATTR.findall(attrs) if attrs else ():
            found.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] else v)
        self.names = f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".strip()
        self.role = found.get("role", "").lower()
        hidden = "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
        self.off = bool(hidden) or tag in DROPPED or self.role in ROLES or (tag == "header" and not in_article)
        self.doubtful = False
        if not self.off and self.names and tag not in ("html", "body", "article", "main"):
            text = re.search(r"(?:^|\s)(?:article|main|content|post|story|entry)[-_]?(?:body|content|text)?(?:\s|$)", self.names, re.I)
            kind = "" if text else furniture(self.names)
            if kind == "comment":
                self.off = True
            elif kind:
                self.doubtful = in_article and (tag in TEXT_TAGS or tag == "section")
                self.off = not self.doubtful


class _Open:
    """The open elements, with their depths by tag, so that an end tag never searches them."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.depths = [root], [], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Close the element at the depth and all that it holds."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK and tag != "p":
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of the tag; 0 where there is none."""
        at = self.depths.get(tag)
        return at[-1] if at else 0

    def end(self, tag: str) -> None:
        """An end tag closes up to its own start, but an inline one never crosses a block."""
        at = self.last(tag)
        inner = max(self.blocks[-1] if self.blocks else 0, self.last("p"))
        if at and (tag in BLOCK or tag in RAW or inner < at):
            self.close(at)

    def begin(self, tag: str) -> None:
        """Close the paragraphs, items and cells that a start tag ends."""
        for open_tag, closers in CLOSES.items():
            at = self.last(open_tag) if tag in closers else 0
            if at and (self.blocks[-1] if self.blocks else 0) <= at:
                self.close(at)


def parse(html: str) -> Node:
    """The page as a tree of nodes and strings; parts that are left out anyway keep no text."""
    root = Node("html", None)
    now = _Open(root)
    end = 0
    pos = 0
    while m := TOKEN.search(html, pos):
        at = now.stack[-1]
        if m.start() > end and not at.off:
            at.children.append(html[end : m.start()])
        pos = end = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            now.end(tag)
            continue
        if tag in ("html", "body"):
            continue
        now.begin(tag)
        at = now.stack[-1]
        node = Node(tag, at, m[3], now.last("article") > 0)
        node.off = node.off or at.off
        at.children.append(node)
        if m[3].rstrip().endswith("/") and not UNQUOTED.search(m[3]):
            continue
        if tag in RAW:
            if close := re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos):
                pos = end = close.end()
            elif tag in SWALLOWS:
                pos = end = len(html)
        elif tag not in VOID:
            now.push(node)
    if end < len(html) and not now.stack[-1].off:
        now.stack[-1].children.append(html[end:])
    return root


def _walk(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.off)
    return out


def measure(nodes: list[Node]) -> dict[Node, tuple[int, int, int]]:
    """Letters, letters in links, and commas below each node."""
    size: dict[Node, tuple[int, int, int]] = {}
    for n in reversed(nodes):
        text = links = commas = 0
        for c in n.children:
            if isinstance(c, str):
                k = len(c.strip())
                text, commas = text + k, commas + c.count(",") + c.count("、") + c.count("،")
            elif c in size:
                a, b, d = size[c]
                text, links, commas = text + a, links + b, commas + d
        size[n] = (text, text if n.tag == "a" else links, commas)
    return size


def _own_text(n: Node, size: dict) -> bool:
    """Whether text stands in the node itself or in inline children."""
    return any((isinstance(c, str) and c.strip()) or (isinstance(c, Node) and not c.off and c.tag not in BLOCK and size[c][0]) for c in n.children)


def best(root: Node) -> list[Node]:
    """The best container and its kept siblings, in page order."""
    nodes = _walk(root)
    size = measure(nodes)
    if doubtful := [n for n in nodes if n.doubtful]:
        for n in doubtful:
            n.off = _linked(n, size) or (n.tag == "section" and size[n][0] < SHORT_SECTION)
        nodes = _walk(root)
        size = measure(nodes)
    for n in nodes:
        text, links, commas = size[n]
        if n.tag not in SCORED or not text or not _own_text(n, size) or n.parent is None:
            continue
        points = (1 + commas + min(text / 100, 3)) * (1 - links / text)
        n.parent.score += points
        if n.parent.parent is not None:
            n.parent.parent.score += points / 2
    for n in nodes:
        text, links, _ = size[n]
        if n.score:
            n.score += 25 * (n.tag in ("article", "main")) + 5 * (n.tag in ("section", "div")) + 10 * bool(n.names and LIKELY.search(n.names)) - 5 * (n.tag in ("ul", "ol", "li", "table", "tr", "td"))
            n.score *= 1 - links / text if text else 0
    top = max(nodes, key=lambda n: n.score, default=root)
    if top.score <= 0:
        return [root]
    top = _whole(top, size)
    if top.parent is None:
        return [top]
    return [c for c in top.parent.children if c is top or _reads(c, size)]


def _linked(n: Node, size: dict) -> bool:
    text, links, _ = size[n]
    return links >= MOST_LINKS * text


def _whole(top: Node, size: dict) -> Node:
    """The outermost article (else main) around the best node, else the section or div whose parts
    it and its siblings are, where little of that is links; else the node itself."""
    around, up = {}, top
    while up is not None:
        around[up.tag] = up
        up = up.parent
    if found := around.get("article") or around.get("main"):
        return found
    return top.parent if top.parent is not None and top.parent.tag in ("section", "div") and not _linked(top.parent, size) else top


def _reads(c: Node | str, size: dict) -> bool:
    """Whether a sibling of the kept container is text: all that has some and isn't mostly links."""
    if isinstance(c, str):
        return bool(c.strip())
    return not c.off and size[c][0] > 0 and not _linked(c, size)


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks, with white space as single spaces and references decoded."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if t := " ".join(unescape("".join(part)).split()):
            out.append(t)
        part.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                part.append(n)
            elif n.tag == "br":
                part.append(" ")
            elif not n.off:
                if n.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(n.children))
        flush()
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(best(parse(html)))) if html else ""


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with ``text``, their main text, in place of the html column."""
    keep = [c for c in pages.columns if c not in (html, "text")]

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            yield pdf[keep].assign(text=[main_text(h) for h in pdf[html]])

    kind = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInPandas(run, f"{kind}, text string")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) AS n_chars")
