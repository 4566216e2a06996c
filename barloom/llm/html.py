"""Main text of web pages by tree scoring.

A page is parsed into a tree. Elements that never hold the article (scripts, navigation, and whatever their class, id
or role names as menu, advert, notice, comments and so on) are left out. Forms, and elements whose names leave it open,
are left out unless most of the page's text is within them. Each paragraph gives points for its length and commas to
its ancestors, less with distance; a container's points are discounted by its link density. The best container, grown
to the article element around it, and those of its siblings that score near it or read as text, are kept, and their
blocks are returned in page order. A page that would come out empty is read again with all but scripts, menus and
controls. Time grows with the page, not with its depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import columns, small_batches

# Kinds of elements, as HTML has them, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template textarea title iframe xmp noembed noframes head nav aside footer header form button select option input dialog menu search svg math canvas "
    "object embed audio video map fieldset".split()
)
_CLOSES_P = BLOCK - {"body", "html", "head"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ITEMS = {t: [k for k in _SAME if t in _SAME[k] or t in _SCOPE[k]] for t in {x for k in _SAME for x in _SAME[k] | _SCOPE[k]}}
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_OTHER = frozenset(
    "ad ads adv advert advertisement advertising advertisements adsense adslot adbox banner banners sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation menu menus breadcrumb "
    "breadcrumbs crumbs sidebar side aside rail masthead footer foot topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox dialog comment comments "
    "disqus replies reply respond responses discussion share sharing social related recommended recommendations recommend newsletter subscribe subscription signup login register search searchbox "
    "toolbar pagination pager skip legal copyright widget widgets outbrain taboola teaser teasers hidden noprint".split()
)
_OTHER_PAIRS = (("site", "header"), ("page", "header"), ("top", "bar"), ("side", "bar"), ("bread", "crumb"), ("sign", "up"), ("tag", "cloud"), ("read", "more"), ("more", "stories"), ("bottom", "bar"))
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_ARTICLE = frozenset("article content main post entry story body text page".split())
_READERS = frozenset("comment comments disqus replies reply respond responses discussion".split())
# Words after which the word before them says what an element is.
_PLACES = frozenset(
    "box wrap wrapper container block section area list lists link links bar inner outer panel slot unit item items group row col column button buttons icon icons form title heading primary secondary "
    "left right top bottom mobile desktop wide large small sticky fixed header nav toggle strip zone region area module card cards grid".split()
)
_RUNS = frozenset("p ul ol li dl dt dd menu blockquote pre h1 h2 h3 h4 h5 h6 caption figure figcaption details summary address hgroup dir".split())
_NEVER_OTHER = frozenset("html body article main".split())

_TAG = re.compile(
    r"<(?:(?P<comment>!--)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<bad>/?[a-zA-Z][^<>]*+>?)|[!?/][^>]*+>?)"
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden|href)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Whether an element is a part of the page besides the article: no, open (by its name or as a form), by its name, always.
NO, OPEN, NAMED, ALWAYS = range(4)
_LEAVES = DROPPED - {"aside", "header", "footer", "form", "dialog", "fieldset"}


class Node:
    __slots__ = ("tag", "parent", "around", "depth", "parts", "other", "score", "chars", "link_chars", "paragraph")

    def __init__(self, tag: str, parent: Node | None, depth: int = 0) -> None:
        self.tag, self.parent, self.depth = tag, parent, depth
        # the nearest block around it, or the root
        self.around: Node | None = parent if parent is None or parent.tag in BLOCK or parent.parent is None else parent.around
        self.parts: list[Node | str] = []
        self.other = NO
        self.score = 0.0
        self.chars = self.link_chars = 0
        self.paragraph = 0


def _kind(tag: str, attrs: str) -> int:
    """NO for an element of the article, else how sure it is that it is another part of the page."""
    if tag in DROPPED:
        return ALWAYS if tag in _LEAVES else OPEN if tag == "form" else NAMED
    if not attrs or tag in ("html", "body"):
        return NO
    names, found = [], False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return NAMED
        if key == "role" and value.strip().lower() in _OTHER_ROLES:
            return NAMED
        if key in ("class", "id"):
            names += value.split()
            found = True
    if not found or tag in _NEVER_OTHER:
        return NO
    words = [_PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower()) for n in names]
    own = [w for n in words for w in n]
    if not (any(w in _OTHER for w in own) or any(p in _OTHER_PAIRS for p in zip(own, own[1:]))):
        return NO
    # "article-with-sidebar" names the article; "article-comments" the comments: the last word counts
    wraps = any(w in ("has", "with", "no") for n in words for w in n[:-1])
    if wraps and (any(not n or n[-1] in _ARTICLE for n in words) or all(w in _OTHER or w in ("has", "with", "no") or w in _ARTICLE for w in own)):
        return NO
    if any(w in _READERS for w in own):
        return ALWAYS
    # "post related-content" also says post; "social-policy" is a policy, but "sidebar-left" a sidebar
    says = any(len(n) == 1 and n[0] in _ARTICLE for n in words)
    heads = [n[-1] for n in words if any(w in _OTHER for w in n)]
    return OPEN if says or heads and all(w not in _OTHER and w not in _PLACES and w not in _ARTICLE and not w.isdigit() for w in heads) else NAMED


class _Open:
    """The elements that are open, from the root down, with what closing rules need to know of them at once."""

    def __init__(self, root: Node) -> None:
        self.path = [root]
        self.blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # by block
        self.items: dict[str, list[Node]] = {t: [] for t in _SAME}

    def push(self, node: Node) -> None:
        self.path.append(node)
        if node.tag in BLOCK:
            self.blocks[node.tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][node.tag] += 1
        for t in _ITEMS.get(node.tag, ()):
            self.items[t].append(node)

    def pop(self) -> None:
        node = self.path.pop()
        if node.tag in BLOCK:
            self.blocks[node.tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][node.tag] -= 1
        for t in _ITEMS.get(node.tag, ()):
            self.items[t].pop()

    def close(self, node: Node) -> None:
        """Closes ``node`` and all within it."""
        while len(self.path) > node.depth:
            self.pop()

    def end(self, tag: str) -> None:
        """An end tag; an inline one doesn't end the block around it, and one without a start changes nothing."""
        if (self.blocks if tag in BLOCK else self.inline[-1])[tag]:
            while self.path[-1].tag != tag:
                self.pop()
            self.pop()

    def before(self, tag: str) -> None:
        """A start tag: ends the paragraph, or the items of its list or row, that it can't stand in."""
        if tag in _CLOSES_P:
            top = self.path[-1]
            block = top if top.tag in BLOCK else top.around
            if block is not None and block.tag == "p":
                self.close(block)
        if tag in _SAME:
            open_items = self.items[tag]
            k = len(open_items)
            while k and open_items[k - 1].tag in _SAME[tag]:
                k -= 1
            if k < len(open_items):
                self.close(open_items[k])


def parse(page: str) -> list[Node]:
    """The elements of a page, the root first. Unclosed and stray tags are repaired the usual way; nothing in a page can make it fail."""
    root = Node("html", None, 1)
    nodes, now = [root], _Open(root)
    at, n = 0, len(page)
    lower = None
    last = page.rfind(">") + 1  # no tag ends after it, so none is looked for
    while True:
        m = _TAG.search(page, at, last)
        if m is None:
            if at < n:
                now.path[-1].parts.append(re.sub(r"<[/!?a-zA-Z][^<]*", "", page[at:]))
            return nodes
        if m.start() > at:
            now.path[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m["comment"]:
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            if tag == "br":
                now.path[-1].parts.append(" ")
            elif tag != "html":
                now.end(tag)
            continue
        if tag == "html":
            continue
        now.before(tag)
        node = Node(tag, now.path[-1], len(now.path) + 1)
        node.parent.parts.append(node)
        node.other = _kind(tag, m["attrs"] or "")
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + tag, at) if len(lower) == n else page.find("</" + tag, at)
            stop = n if end < 0 else page.find(">", end)
            at = n if stop < 0 or end < 0 else stop + 1
            continue
        now.push(node)


def _squeezed(chunks: list[str]) -> str:
    return " ".join(unescape("".join(chunks)).split())


def _measure(nodes: list[Node]) -> list[tuple[Node, int, int]]:
    """Sets the text and link characters of every node; returns (block, its own characters, its commas)."""
    found = []
    root = nodes[0]
    for x in nodes:
        x.score, x.chars, x.link_chars, x.paragraph = 0.0, 0, 0, 0

    def own(node: Node, chunks: list[str], linked: list[str], in_link: bool) -> None:
        """Text of a block outside the blocks within it; measures those on the way."""
        stack: list[tuple[Node, Iterator, bool]] = [(node, iter(node.parts), in_link)]
        while stack:
            top, parts, link = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
            elif isinstance(part, str):
                chunks.append(part)
                if link:
                    linked.append(part)
            elif part.tag == "br":
                chunks.append(" ")
            elif not part.other:
                if part.tag in BLOCK:
                    blocks.append((part, link or part.tag == "a"))
                else:
                    stack.append((part, iter(part.parts), link or part.tag == "a"))

    blocks: list[tuple[Node, bool]] = [(root, False)]
    k = 0
    while k < len(blocks):
        node, link = blocks[k]
        k += 1
        chunks: list[str] = []
        linked: list[str] = []
        own(node, chunks, linked, link)
        text = _squeezed(chunks)
        if text:
            n, links = len(text), len(_squeezed(linked)) if linked else 0
            node.paragraph = node.chars = n
            node.link_chars = links
            found.append((node, n, text.count(",") + text.count("，") + text.count("、")))
    for x in nodes[:0:-1]:  # every element after those it is in
        x.parent.chars += x.chars
        x.parent.link_chars += x.link_chars
    return found


def _settle(nodes: list[Node]) -> None:
    """Of the elements that are open, those with most of the page's text without links are the article's."""
    if any(x.other == OPEN for x in nodes):
        kinds = [x.other for x in nodes]
        for x in nodes:
            if x.other == OPEN:
                x.other = NO
        _measure(nodes)
        total = nodes[0].chars - nodes[0].link_chars
        for x, kind in zip(nodes, kinds):
            if kind == OPEN and 2 * (x.chars - x.link_chars) <= total:
                x.other = NAMED


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _menu(node: Node) -> bool:
    """A list or division of nothing but links."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.chars > 0 and _density(node) > 0.8 and sum(1 for p in node.parts if isinstance(p, Node)) >= 2


def chosen(nodes: list[Node]) -> list[Node]:
    """The containers that hold the article, in page order; none if the page has no text."""
    paragraphs = _measure(nodes)
    if not paragraphs:
        return []
    scored: dict[int, Node] = {}
    for least in (25, 1):
        for node, n, commas in paragraphs:
            if n >= least and node.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                points = (1.0 if least > 1 else n / 25) + commas + min(n // 100, 3)
                up, level = node.around if node.around is not None else node, 0
                while up is not None and level < 5:
                    up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    scored[id(up)] = up
                    level += 1
                    up = up.around
        if scored:
            break
    if not scored:  # headings only
        for node, n, _ in paragraphs:
            up = node.parent or node
            up.score += n / 25
            scored[id(up)] = up
    value = lambda x: x.score * (1 - _density(x))
    best = max(scored.values(), key=lambda x: (value(x), -x.depth))  # of equals the one around the other
    while best.tag in _RUNS and best.around is not None:  # a list or quotation is part of what is around it
        best = best.around
    over = [best]
    while over[-1].parent is not None:
        over.append(over[-1].parent)
    articles = [x for x in over if x.tag == "article"]
    first = next((x for x in over if x.tag in ("article", "main")), None)
    best = articles[-1] if articles and first is not None else first or best
    if best.parent is None or best.tag in ("article", "main", "body"):
        peers = [p for p in best.parent.parts if isinstance(p, Node) and p.tag == best.tag and not p.other] if best.parent is not None and best.tag == "article" else []
        return [p for p in peers if p is best or value(p) >= 0.2 * value(best)] or [best]
    keep = []
    for x in best.parent.parts:
        if not isinstance(x, Node) or x.other:
            continue
        near = value(x) > 0 and value(x) >= 0.2 * value(best)
        reads = x.tag in ("p", "h1", "h2", "blockquote", "pre") and x.paragraph > 0 and _density(x) < (0.25 if x.paragraph > 80 else 0.01)
        if x is best or near or reads:
            keep.append(x)
    return keep


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks within the containers, in page order."""
    out: list[str] = []
    chunks: list[str] = []

    def flush() -> None:
        if chunks:
            if text := _squeezed(chunks):
                out.append(text)
            chunks.clear()

    for top in nodes:
        stack: list[tuple[Node, Iterator]] = [(top, iter(top.parts))]
        while stack:
            node, parts = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
                if node.tag in BLOCK:
                    flush()
            elif isinstance(part, str):
                chunks.append(part)
            elif part.tag == "br":
                chunks.append(" ")
            elif not part.other and not _menu(part):
                if part.tag in BLOCK:
                    flush()
                stack.append((part, iter(part.parts)))
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page; empty where there is none."""
    if not page:
        return ""
    nodes = parse(page)
    _settle(nodes)
    text = "\n".join(blocks(chosen(nodes)))
    if not text:
        for x in nodes:
            x.other = ALWAYS if x.other == ALWAYS else NO
        text = "\n".join(blocks(chosen(nodes)))
    return text


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row a row of ``pages``.

    Character references are decoded, white space within a block is one blank, blocks are joined by one line feed.
    A null or empty page, or one without text, has an empty text. Nothing is cut off, however long or deep a page is.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    own = columns(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), "url", "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
