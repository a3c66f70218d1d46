"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree.  Paragraphs pass points (one each, one
per comma, one per hundred characters up to three) to their container, and half of
what an element gets goes on to its parent, up to the root; an ancestor's points are
discounted by its link density.  The best container, raised to the article or main
element around it, and those siblings that score or read like it are kept;
boilerplate inside them is left out.

A form that holds most of the page's paragraphs is the page, not a form.  Inside an
article or main element, a part whose name has a weak word for boilerplate among
others (side-by-side, related-work) is kept if its paragraphs are text and not links.

Null and empty pages, and pages without text, give an empty text.  Broken and cut
off markup is read as far as it goes.  Rows are worked on one by one, so repeated
ids or pages give equal rows; a page of any length is read whole, in time linear in
it.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp", "noembed"}
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII) for name in RAW}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: An opening tag that ends an open element of these kinds, up to the nearest of the last kinds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
DROPPED = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "iframe", "object", "embed", "svg", "canvas", "button", "select", "textarea", "dialog", "menu", "input", "math", "audio", "video", "map", "noframes", "search", "noembed"}
#: Parts of class and id names that mark boilerplate.
BAD_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "widget", "widgets", "footer", "foot", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "share", "sharing", "social", "subscribe", "subscription", "newsletter", "signup", "login", "related", "recommended", "recommendations", "pagination", "pager", "skip", "hidden", "search", "searchform", "copyright", "legal", "disclaimer", "paywall"}
#: Of these, the words that also name parts of articles when they stand beside other words.
WEAK_WORDS = {"side", "related", "legal", "search", "skip", "alert", "foot", "overlay", "hidden", "reply", "replies", "promotion", "banner"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
GOOD_WORDS = {"article", "post", "entry", "content", "story", "body", "main", "text"}

_TOKEN = re.compile(r"<!--(?:.*?)(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?:/?[a-zA-Z])[^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CONTENT_CLASSES = re.compile(r"article|entry|post|story", re.I)


class Node:
    __slots__ = ("attributes", "children", "parent", "points", "size", "tag", "link_size", "bad", "prose", "prose_links", "is_page")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.points, self.size, self.link_size, self.bad = 0.0, 0, 0, False
        # Characters of paragraphs below, those of them in links; whether a form is the page itself.
        self.prose, self.prose_links, self.is_page = 0, 0, False


def parse(page: str) -> Node:
    """The element tree; comments, declarations and raw texts are left out."""
    root = top = Node("#root", None)
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if page[at:]:
                top.children.append(html.unescape(page[at:]))
            return root
        if m.start() > at:
            top.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, attributes = name.lower(), (m[3] if m[2] else m[6]) or ""
        if m[1] or m[4]:
            node = top
            while node.parent and node.tag != name:
                node = node.parent
            if node.parent:
                top = node.parent
            continue
        kinds, stops = CLOSES.get(name, (None, None))
        if name in BLOCKS and kinds is None:
            kinds, stops = {"p"}, {"td", "th", "table", "button", "caption", "li", "dd", "div", "section", "article", "blockquote"}
        if kinds:
            node, last = top, None
            while node.parent and node.tag not in stops:
                if node.tag in kinds:
                    last = node
                node = node.parent
            if last is not None:
                top = last.parent
        node = Node(name, top, attributes)
        top.children.append(node)
        if name in RAW:
            # On the page itself: letters that grow in lower case would shift places.
            end = _END[name].search(page, at)
            at = len(page)
            if end:
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
        elif name not in VOID and not (attributes.endswith("/") and name in ("path", "circle", "rect", "use")):
            top = node


def _words(value: str) -> set[str]:
    return {w.lower() for w in _NAME.findall(value)}


def is_boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element is no part of the main text; inside: of an article or main element."""
    if node.tag in DROPPED and not node.is_page:
        return True
    if node.tag == "header" and not inside:
        return True
    if not node.attributes or node.tag in ("html", "body", "article", "main", "#root"):
        return False
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(node.attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
        return True
    if values.get("role", "").lower() in BAD_ROLES:
        return True
    named = f"{values.get('class', '')} {values.get('id', '')}"
    words = _words(named)
    if words & BAD_WORDS:
        if inside and words - BAD_WORDS and words & BAD_WORDS <= WEAK_WORDS and node.prose >= 25 and node.prose_links < 0.25 * node.prose:
            return False
        # Names like "post-with-comments" on the content itself are no sign against it.
        return not (words & {"content", "article", "entry", "post", "story"} and not words & {"comment", "comments", "ad", "ads", "related", "share", "nav", "footer", "sidebar", "reply", "notice"})
    return "header" in words and not inside and not _CONTENT_CLASSES.search(named)


def _weigh_paragraphs(root: Node) -> None:
    """How many characters of paragraphs lie below each element, and which forms hold most of the page's."""
    order, stack = [], [(root, False, False)]
    own: list[tuple[int, int]] = []
    while stack:
        node, paragraph, link = stack.pop()
        paragraph, link = paragraph or node.tag == "p", link or node.tag == "a"
        order.append(node)
        size = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if paragraph else 0
        own.append((size, size if link else 0))
        stack.extend((c, paragraph, link) for c in node.children if isinstance(c, Node) and c.tag not in RAW)
    for node, (size, links) in zip(reversed(order), reversed(own), strict=True):
        node.prose += size
        node.prose_links += links
        if node.parent is not None:
            node.parent.prose += node.prose
            node.parent.prose_links += node.prose_links
    for node in order:
        node.is_page = node.tag == "form" and 2 * node.prose > root.prose


def _measure(root: Node) -> list[Node]:
    """Text and link sizes of all elements that are no boilerplate; these elements, in page order."""
    _weigh_paragraphs(root)
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        node.bad = is_boilerplate(node, inside)
        if node.bad:
            continue
        order.append(node)
        inside |= node.tag in ("article", "main")
        stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            elif not c.bad:
                node.size += c.size
                node.link_size += c.size if c.tag == "a" else c.link_size
    return order


def _density(node: Node) -> float:
    return min(1.0, node.link_size / node.size) if node.size else 0.0


def _paragraph(node: Node) -> str | None:
    """The text of a paragraph: of such an element, or directly in another block."""
    if node.tag in ("p", "pre", "td", "blockquote", "dd", "li"):
        return "".join(_inline(node))
    if node.tag in BLOCKS and any(isinstance(c, str) and len(c.strip()) >= 25 for c in node.children):
        return "".join(c for c in node.children if isinstance(c, str))
    return None


def _inline(node: Node) -> Iterator[str]:
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif not x.bad and (x is node or x.tag not in BLOCKS):
            if x.tag == "br":
                yield " "
            stack.extend(reversed(x.children))


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below node, in page order."""
    out, now, stack = [], [], [node]
    end = object()

    def close() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    while stack:
        x = stack.pop()
        if x is end:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif not x.bad:
            if x.tag == "br":
                now.append(" ")
            elif x.tag in BLOCKS:
                close()
                stack.append(end)
            stack.extend(reversed(x.children))
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    scored = []
    for node in order:
        text = _paragraph(node)
        if text is None or len(text.strip()) < 25:
            continue
        up = node.parent if node.tag in ("p", "pre", "td", "blockquote", "dd", "li") else node
        if up is not None:
            up.points += 1 + text.count(",") + min(len(text) // 100, 3)
    for node in reversed(order):  # children before their parents
        if node.points and node.tag != "#root":
            if node.parent is not None:
                node.parent.points += node.points / 2
            words = _words(node.attributes)
            node.points += 0.1 + 25 * bool(node.tag in ("article", "main")) + 5 * (node.tag == "div") + 10 * bool(words & GOOD_WORDS) - 3 * (node.tag in ("ul", "ol", "dl", "td", "th", "address"))
            scored.append(node)
    scored.reverse()
    if not scored:
        articles = [n for n in order if n.tag in ("article", "main")]
        best = max(articles, key=lambda n: n.size, default=root)
        return "\n\n".join(blocks(best if best.size else root))
    rank = {id(n): n.points * (1 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: rank[id(n)])
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if best.tag in ("html", "body", "#root") or best.parent is None:
        return "\n\n".join(blocks(best))
    least = max(10.0, 0.2 * rank.get(id(best), 0.0))
    kept = []
    for sibling in best.parent.children:
        if sibling is best:
            kept.append(best)
        elif isinstance(sibling, Node) and not sibling.bad:
            density = _density(sibling)
            good = rank.get(id(sibling), 0.0) >= least
            if sibling.tag == "p":
                good |= sibling.size > 80 and density < 0.25 or 0 < sibling.size <= 80 and density == 0 and best.tag not in ("article", "main")
            if sibling.tag in ("h1", "h2", "h3", "h4", "header", "hgroup", "figure", "pre", "blockquote"):
                good |= density < 0.25 and best.tag not in ("article", "main")
            if good:
                kept.append(sibling)
    return "\n\n".join(t for n in kept for t in blocks(n))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_arrow(kept, run, "page_id long, url string, text string, n_chars long")
