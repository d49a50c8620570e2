"""Main text of web pages by composite text density.

A page becomes a tree of nodes with implied end tags. Every node gets the characters and tags
below it, also those inside links, and from them a density: characters per tag, lowered the more
of them are link text. The node whose children's densities sum to the most is the content, with
those around it that add text and hardly links. The smallest density on its path up to the body
is the threshold; of the content's subtree those blocks are left out that fall below it and hold
mostly links. Navigation and scripts never count as content; nor do forms and what is named as advert,
notice, sidebar or comments, unless they hold most of the body's text outside links and of the article elements: then
they wrap the article.

Text is joined block by block: character references are decoded, white space within a block
becomes one space, and blocks stand on lines of their own. Null and empty pages, and pages
without content, have an empty text. Broken and cut-off markup is read as far as it goes; pages are
read whole. Repeated rows are read alike. Empty tables give no rows; extra columns pass through,
and outputs replace columns of the same name.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridpanel.llm.arrowtext import filled, slices

# Kinds of elements as HTML names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template head title iframe object embed applet canvas svg math nav footer aside button select textarea input "
    "dialog menu audio video map noembed noframes".split()
)
#: What an opening tag ends if it is open, up to the nearest of the tags that hold it.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "th": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
ENDS_P = BLOCKS - frozenset("body html caption dd dt legend li optgroup option summary tbody td tfoot th thead tr".split())
P_HOLDERS = frozenset("td th caption button object html body table".split())
#: Words of a class, id or role that name what is not the article.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent notice gdpr popup modal overlay share sharing social related recommended newsletter subscribe "
    "subscription comment comments commentlist respond disqus pagination pager toolbar widget toc search contentinfo complementary".split()
)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.doubtful = tag, parent, dropped, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    return False


def _doubtful(tag: str, attributes: str) -> bool:
    """Whether an element is a form or named as something else than the article."""
    if tag == "form":
        return True
    if tag in ("body", "html", "article", "main") or "=" not in attributes:
        return False
    return any(w.lower() in NOT_CONTENT for m in _NAMES.finditer(attributes) for w in _PARTS.findall(m[1] or m[2] or m[3] or ""))


def parse(page: str) -> Node:
    """The page's tree; texts stand among the children as strings, not yet decoded."""
    root = Node("html", None, False)
    node, at, end, articles = root, 0, len(page), 0
    open_: dict[str, int] = {}

    def close(target: Node) -> Node:
        nonlocal node, articles
        while node is not target:
            open_[node.tag] -= 1
            articles -= node.tag in ("article", "main")
            node = node.parent
        open_[node.tag] -= 1
        articles -= node.tag in ("article", "main")
        return node.parent

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                node.children.append(" ")
            elif tag == "p" and not open_.get("p"):
                node.children.append(Node("p", node, node.dropped))
            elif open_.get(tag) and tag not in ("html", "body"):
                found = node
                while found.tag != tag:
                    found = found.parent
                node = close(found)
            continue
        if tag in ("html", "body") and open_.get(tag) or tag == "html":
            continue
        if tag in ENDS_P and open_.get("p"):
            found = node
            while found.tag != "p" and found.tag not in P_HOLDERS:
                found = found.parent
            if found.tag == "p":
                node = close(found)
        if tag in ENDS:
            ended, holders = ENDS[tag]
            found, last = node, None
            while found is not None and found.tag not in holders:
                if found.tag in ended:
                    last = found
                found = found.parent
            if last is not None:
                node = close(last)
        attributes = m[3] or ""
        if tag == "body" and open_.get("head"):
            found = node
            while found.tag != "head":
                found = found.parent
            node = close(found)
        child = Node(tag, node, node.dropped or _unwanted(tag, attributes, articles > 0))
        child.doubtful = not child.dropped and _doubtful(tag, attributes)
        node.children.append(child)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            inner = page[at : stop.start() if stop else end]
            if tag == "textarea":
                child.children.append(inner)
            at = end if stop is None else page.find(">", stop.end()) + 1 or end
            continue
        open_[tag] = open_.get(tag, 0) + 1
        articles += tag in ("article", "main")
        node = child
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents before their children; without recursion, as pages can be nested deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _settle(order: list[Node], body: Node) -> None:
    """Drop doubtful nodes with all below them, except those with most of the body's characters outside links.

    On pages whose article is marked as such, they must hold most of its characters too: next to a short
    article an advert may have more.
    """
    plain: dict[int, int] = {}
    for n in reversed(order):
        if n.dropped or n.tag == "a":
            plain[id(n)] = 0
        else:
            plain[id(n)] = sum(len(c.strip()) if isinstance(c, str) else plain[id(c)] for c in n.children)
    few = {id(n) for n in order if n.doubtful and 2 * plain[id(n)] <= plain[id(body)]}
    marked: dict[int, int] = {}
    for n in reversed(order):
        inner = sum(marked[id(c)] for c in n.children if isinstance(c, Node))
        marked[id(n)] = 0 if n.dropped or id(n) in few else plain[id(n)] if n.tag in ("article", "main") else inner
    for n in order:
        wraps = id(n) not in few and 2 * marked[id(n)] >= marked[id(body)]
        if n.parent is not None and n.parent.dropped or n.doubtful and not wraps:
            n.dropped = True


def measure(root: Node) -> Node:
    """Fill in counts, densities and sums of densities; return the body, or the root without one."""
    order = _order(root)
    body = next((n for n in order if n.tag == "body"), root)
    _settle(order, body)
    for n in reversed(order):
        if n.dropped:
            continue
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c.strip())
            elif not c.dropped:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(order):
        if n.dropped:
            continue
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            n.density = c / t * math.log(max(c * t / (max(lc, 1) * lt), 1.0) + 1e-9 + math.e - 1) / max(base, 1.0)
        n.total = sum(k.density for k in n.children if isinstance(k, Node) and not k.dropped)
        # text of the node itself counts as a child without tags
        n.total += sum(len(k.strip()) for k in n.children if isinstance(k, str))
    return body


def _within(node: Node, top: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        if node is top:
            return
        node = node.parent


def content(root: Node) -> tuple[Node | None, float]:
    """The node with the largest sum of densities, and the smallest density between it and the body."""
    body = measure(root)
    best = None
    for n in _order(body):
        if not n.dropped and n.chars and (best is None or n.total > best.total):
            best = n
    if best is None:
        return None, 0.0
    # a single block is content together with the article around it: climb while a parent adds text but hardly links
    top = best
    while top is not body and top.parent is not None and top.parent is not body:
        up = top.parent
        more, links = up.chars - top.chars, up.link_chars - top.link_chars
        if links > 0.5 * more and more:
            break
        top = up
    if top.parent is body and top is not body:
        around = body.chars - top.chars
        if around and body.link_chars - top.link_chars <= 0.2 * around and around > 0.1 * top.chars:
            top = body
    return top, min(n.density for n in _within(best, body))


def text_of(page: str) -> str:
    root = parse(page)
    top, threshold = content(root)
    if top is None:
        return ""
    blocks, parts = [], []

    def end_block() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                blocks.append(line)

    stack: list[Node | str | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            parts.append(item)
        elif item.dropped:
            if item.tag in BLOCKS:
                end_block()
        elif item.tag in ("br", "wbr", "hr"):
            parts.append("" if item.tag == "wbr" else " ")
        elif item is not top and item.tag in BLOCKS and item.density < threshold and item.link_chars > 0.6 * item.chars:
            end_block()  # below the path's threshold and mostly links: a menu within the content
        else:
            block = item.tag in BLOCKS
            if block:
                end_block()
                stack.append(None)
            stack.extend(reversed(item.children))
    end_block()
    return "\n".join(blocks)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page; null pages have an empty one."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, page):
                texts = [text_of(p) for p in filled(part.column(page)).to_pylist()]
                kept = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != out}
                yield pa.RecordBatch.from_pydict(kept | {out: pa.array(texts, pa.string())})

    fields = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(read, T.StructType([*fields, T.StructField(out, T.StringType())]))
