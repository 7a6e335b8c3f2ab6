"""Main text of web pages by composite text density.

A page becomes a tree of block and link elements. Every node gets its
characters per tag, adjusted by how many of them stand in links and by the
page's own share of links; a node's density sum adds up those of its children,
runs of text counting as children. The node of the greatest sum is the core of
the article. The least density on its path up to the body is the threshold:
every branch of the page that reaches it gives its own node of greatest sum,
and the smallest subtree below the body that holds those nodes is the article.
Elements that never carry article text (menus, forms, scripts and the like) are
left out before densities are taken, and so are reader comments and adverts, and
elements whose names hint at notices and the like, unless most of the text is theirs.

One map over the table; a page is read once and its tree is dropped at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
DROPPED = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "embed", "applet", "svg", "math", "canvas", "audio",
    "video", "map", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "fieldset", "dialog", "menu",
    "noembed", "noframes", "title",
}
#: Start tags that end an open paragraph, and for list-like elements the open elements they end.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "section", "table", "ul", "li", "dd", "dt",
}
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "blockquote", "aside", "nav", "header", "footer", "form"}
#: Words in class, id and role values that mark boilerplate.
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "nav", "navbar",
    "navigation", "newsletter", "notice", "pagination", "popup", "modal", "promo", "related", "replies", "respond", "share", "sharing",
    "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "search", "contentinfo", "complementary", "alertdialog",
}
#: Of these, the words that surely mark reader comments and adverts; what before or after them only tells of a page's state.
SURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "comment", "comments", "commentlist", "disqus", "replies",
    "respond", "sponsor", "sponsored",
}
STATES = {"has", "with", "no", "without", "show", "open", "closed", "enabled", "disabled", "allowed", "off"}

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
QUOTE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parts", "parent", "dropped", "marked", "inside", "wraps", "free", "left", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.parts, self.dropped, self.marked, self.inside = name, parent, [], False, None, False


def hinted(attributes: str) -> str | None:
    """"hidden" for an element that is not shown, "sure" or "marked" for one whose class, id or role has a word of boilerplate."""
    if "=" not in attributes:
        return None
    found = None
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))]
                if words and (words[0] in HINTS or words[-1] in HINTS) and not {words[0], words[-1]} & STATES:
                    found = "sure" if words[0] in SURE or words[-1] in SURE or found == "sure" else "marked"
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hidden"
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
    return "hidden" if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes) else found


def tag_end(page: str, at: int) -> int | None:
    """The place after the ``>`` that ends a tag, quoted ones skipped; None if a quote stays open to the end."""
    while m := QUOTE.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return None
    return len(page)


def parse(page: str) -> Node:
    """The tree of a page, pruned; inline elements are transparent, line breaks are blanks."""
    root = body = Node("html", None)
    at, quotes, standing = 0, True, Counter()

    def leave(to: Node) -> Node:
        node = body
        while node is not to:
            standing[node.name] -= 1
            node = node.parent
        return to

    for m in iter(lambda: MARK.search(page, at), None):
        if m.start() > at:
            body.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        name, begin = m[2].lower(), at
        at = tag_end(page, at) if quotes else None
        if at is None:  # broken quotes: from here on the first > ends a tag
            quotes = False
            at = page.find(">", begin) + 1 or len(page)
        attributes = page[begin : at - 1]
        if m[1]:
            if standing[name]:
                node = body
                while node.name != name:
                    node = node.parent
                body = leave(node.parent)
            continue
        if name in RAW:
            at = raw_end(page, at, name)
        elif name == "br":
            body.parts.append(" ")
        elif name not in ("html", "body", "thead", "tbody", "tfoot", "wbr"):
            hint = hinted(attributes)
            if name in INLINE and not hint:
                continue
            if name in ENDS_P and standing["p"]:
                body = leave(closed(body, {"p"}))
            if name in ENDS:
                body = leave(closed(body, ENDS[name]))
            node = Node(name, body)
            node.inside = body.inside or name in ("article", "main")
            whole = name in ("article", "main")
            node.dropped = name in DROPPED or (hint == "hidden" and not whole) or (name == "header" and not node.inside)
            node.marked = hint if hint in ("sure", "marked") and not whole else None
            body.parts.append(node)
            if name not in VOID and not attributes.endswith("/"):
                standing[name] += 1
                body = node
    if at < len(page):
        body.parts.append(html.unescape(page[at:]))
    for node in reversed(nodes(root)):
        # what wraps the article itself stays: an element that was never closed, or a form around the whole page
        node.wraps = {n for p in node.parts if not isinstance(p, str) for n in (p.wraps | {p.name}) & {"article", "main", "h1"}}
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.dropped or p.wraps & {"article", "main"}
                      or (p.name == "form" and "h1" in p.wraps)]
        own = sum(len(SPACE.sub("", p)) for p in node.parts if isinstance(p, str))
        node.free = own + sum(p.free for p in node.parts if not isinstance(p, str)) if node.name != "a" else 0
    return without_marked(root)


def without_marked(root: Node) -> Node:
    """Leave out marked elements: reader comments and adverts always, others if they hold less than half of the text outside of links.

    Where an article or main element stands elsewhere those others go whatever
    they hold, too; inside of it a heading of the page stays. If nothing but
    links would be left, all stay.
    """
    kept, order = {}, nodes(root)
    whole = bool(root.wraps & {"article", "main"})

    def goes(p: Node) -> bool:
        if not p.marked or p.wraps & {"article", "main"} or (p.inside and "h1" in p.wraps | {p.name}):
            return False
        return p.marked == "sure" or 2 * p.free < root.free or (whole and not p.inside)

    for node in reversed(order):
        kept[id(node)] = [p for p in node.parts if isinstance(p, str) or not goes(p)]
        own = sum(len(SPACE.sub("", p)) for p in kept[id(node)] if isinstance(p, str))
        node.left = own + sum(p.left for p in kept[id(node)] if not isinstance(p, str)) if node.name != "a" else 0
    if root.left or not root.free:
        for node in order:
            node.parts = kept[id(node)]
    return root


def raw_end(page: str, at: int, name: str) -> int:
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def closed(node: Node, names: set[str]) -> Node:
    """The place after the nearest open element of ``names`` is ended, if nothing that shields it is in between."""
    look = node
    while look.parent is not None and (look.name in names or look.name not in SCOPE):
        if look.name in names:
            return look.parent
        look = look.parent
    return node


def nodes(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [p for p in node.parts if not isinstance(p, str)]
    return found


def weigh(root: Node) -> list[Node]:
    """Counts, densities and density sums of every node."""
    order = nodes(root)
    for node in reversed(order):
        node.chars, node.tags, node.link_chars, node.link_tags = 0, 0, 0, 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(SPACE.sub("", part))
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.chars if part.name == "a" else part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
    share = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share) if node.name != "a" else 0.0
        own = [p for p in node.parts if isinstance(p, str)]
        free = sum(len(SPACE.sub("", p)) for p in own)
        # a run of text is a child without tags and links
        node.total = density(free, 0, 0, 0, share) if free and node.name != "a" else 0.0
        node.best = node
        for part in node.parts:
            if not isinstance(part, str):
                node.total += part.density
        for part in node.parts:
            if not isinstance(part, str) and part.best.total > node.best.total:
                node.best = part.best
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, times the log of how rare links are here, to a base that grows with links of node and page."""
    if not chars:
        return 0.0
    tags, link_chars, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    value = chars / link_chars * tags / link_tags
    return chars / tags * max(0.0, math.log(max(value, 1e-9)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else 0.0)


def article(root: Node) -> list[Node]:
    """The subtrees of the article, in page order."""
    weigh(root)
    core = root.best
    path, node = [], core
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    chosen, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.density < threshold or not node.chars:
            continue
        chosen.append(node.best)
        stack += [p for p in node.parts if not isinstance(p, str)]
    chosen.append(core)
    lines = []
    for node in {id(n): n for n in chosen}.values():
        line = []
        while node is not None:
            line.append(node)
            node = node.parent
        lines.append(line[::-1])
    shared = 0
    while all(len(line) > shared and line[shared] is lines[0][shared] for line in lines):
        shared += 1
    top = lines[0][shared - 1]
    if top.parent is not None:
        # an article or main element is one whole
        node = top
        while node is not None and node.name not in ("article", "main"):
            node = node.parent
        return [node or top]
    return [top]


def blocks(tops: list[Node]) -> list[str]:
    """Texts of blocks: links run on in their block, any other element begins and ends one."""
    found, run = [], []

    def end() -> None:
        line = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line:
            found.append(line)

    stack: list = list(reversed(tops))
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            run.append(part)
        elif part.name == "a" or part.name == "img":
            stack += reversed(part.parts)
        else:
            end()
            stack.append(None)
            stack += reversed(part.parts)
    end()
    return found


def main_text(page: str | None) -> str:
    """The article of a page, one block a line; empty for null, empty or textless pages."""
    if not page:
        return ""
    return "\n".join(blocks(article(parse(page))))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of ``pages`` (html, ...), text and n_chars (code points), one row for each row.

    The whole page is read. Null and empty pages, and those without text, give an
    empty text; broken markup is read as far as it makes sense; repeated rows
    give repeated rows; an empty table gives none. Other columns are ignored.
    """
    source = pages.select(F.struct(*keep).alias("_key"), F.col("html").cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_key", "text", "n_chars"])

    schema = f"_key {source.schema['_key'].dataType.simpleString()}, text string, n_chars long"
    return source.mapInArrow(run, schema).select("_key.*", "text", "n_chars")
