"""Main text of web pages by scoring the document tree.

A page is cut into tags and text and built into a tree with the usual implied ends (a paragraph ends where a block
begins, and so on).  Every paragraph passes points, one and one more for each comma and for each hundred characters
(three at most), to its parent whole, to its grandparent by half and on to all further ancestors by a third of what
the one below got; this is one pass from the leaves up.  An ancestor's points are discounted by its link density.  The container with most points, and siblings
that score well enough or are real paragraphs, are the article; menus, notices, forms and the like inside it go.

Null and empty pages have the empty text.  Unclosed, crossed or cut-off tags are closed by their parents.  The whole
page is read, whatever its length; nesting is followed iteratively, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe)\b[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|$)|$)"
    # Left open, these end with their tag: what follows is the page.
    r"|<(?P<field>textarea|select|object|title)\b[^>]*(?:/>|>.*?</(?P=field)\s*>|>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^<>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav header footer aside form button input select textarea dialog menu head label fieldset canvas audio video".split())
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
CONTAINER = frozenset("article body div main section td".split())
ENDS = {  # what an opening tag ends, and where that stops
    "li": (("li",), frozenset("ul ol menu dir".split())),
    "dt": (("dt", "dd"), frozenset(["dl"])),
    "dd": (("dt", "dd"), frozenset(["dl"])),
    "tr": (("tr", "td", "th"), frozenset(["table"])),
    "td": (("td", "th"), frozenset("tr table".split())),
    "th": (("td", "th"), frozenset("tr table".split())),
    "option": (("option",), frozenset(["select"])),
}
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "body": 0.0, "ul": -3.0, "ol": -3.0}
#: Words in names (class, id, role) of what is no article, by the role they stand for.  Whole words, as names are cut at
#: all but letters.
_ROLE_WORDS = {
    "ways around the site": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar tags",
    "frame of the page": "header footer sidebar copyright widget",
    "advertising": "ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sponsors",
    "notices": "cookie cookies consent gdpr notice alert warning popup modal paywall disclaimer hidden",
    "other pages": "related recommended recommendations trending popular teaser",
    "readers": "comment comments reply replies response responses feedback",
    "signing up and sharing": "login signup subscribe subscription newsletter share sharing social rss",
}
_UNLIKELY = re.compile(r"(?:^|[^a-z])(?:" + "|".join(" ".join(_ROLE_WORDS.values()).split()) + r")(?:$|[^a-z])")
#: Words in names of what holds an article.
_LIKELY = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|post|story|text)(?:$|[^a-z])")
#: Roles whose words count even where a name has a word of an article too, as in post-comments.
_NEVER = re.compile(r"(?:^|[^a-z])(?:" + "|".join(" ".join(_ROLE_WORDS[k] for k in ("ways around the site", "advertising", "notices", "readers", "signing up and sharing")).split()) + r"|sidebar|footer|related)(?:$|[^a-z])")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_ROLES = re.compile(r"\b(?:navigation|banner|complementary|contentinfo|search|form|dialog|alert|menu|menubar)\b")


class Node:
    __slots__ = ("tag", "names", "hidden", "parent", "kids", "points", "paragraph")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.names = " ".join(m.strip("\"'") for m in _NAMES.findall(attrs)).lower() if "=" in attrs else ""
        self.hidden = bool(attrs) and _HIDDEN.search(attrs) is not None
        self.points: float | None = None
        self.paragraph = False


def parse(page: str) -> Node:
    """The tree; texts are strings among a node's kids, with character references decoded."""
    root = node = Node("body", "", None)
    opened: Counter[str] = Counter()  # tags from the root to node, so that looking up is done only if it finds something

    def to(target: Node) -> Node:
        at = node
        while at is not target:
            opened[at.tag] -= 1
            at = at.parent
        return at

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            node.kids.append(html.unescape(text) if "&" in text else text)
            continue
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br":
                node.kids.append(" ")
            elif opened[tag]:
                node = to(next(x for x in _up(node) if x.tag == tag).parent)
            continue
        if tag in ("html", "body"):  # the root stands for both
            if tag == "body":
                node = to(root)
            continue
        if tag in BLOCK:
            if opened["head"]:  # a head that was left open
                node = to(root)
            if opened["p"]:  # a block ends an open paragraph
                for x in _up(node):
                    if x.tag == "p":
                        node = to(x.parent)
                        break
                    if x.tag in ("td", "th", "button", "object", "caption"):
                        break
        if tag in ENDS and any(opened[n] for n in ENDS[tag][0]):
            until = None
            for x in _up(node):
                if x.tag in ENDS[tag][1]:
                    break
                if x.tag in ENDS[tag][0]:
                    until = x
            if until is not None:
                node = to(until.parent)
        if tag in VOID:
            if tag == "hr":
                node.kids.append(Node(tag, "", node))
            elif tag == "br":
                node.kids.append(" ")
            continue
        new = Node(tag, m["attrs"] or "", node)
        node.kids.append(new)
        if not (m["attrs"] or "").rstrip().endswith("/"):
            node = new
            opened[tag] += 1
    return root


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def unlikely(node: Node) -> bool:
    """Whether the tag, its names or its state say that it is no part of an article."""
    if node.hidden or (node.tag in DROPPED and not (node.tag == "header" and any(x.tag == "article" for x in _up(node)))):
        return True
    if not node.names or node.tag in ("article", "main"):
        return False
    return bool(_ROLES.search(node.names)) or (_UNLIKELY.search(node.names) is not None and _LIKELY.search(node.names) is None) or _always(node.names)


def _always(names: str) -> bool:
    return _NEVER.search(names) is not None


def _prune(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        kept = []
        for k in node.kids:
            if isinstance(k, str):
                kept.append(k)
            elif not unlikely(k):
                kept.append(k)
                todo.append(k)
            else:
                kept.append(Node("hr", "", node))  # what stood before and after it stays apart
        node.kids = kept


def _measure(root: Node) -> tuple[list[Node], dict[int, list[float]]]:
    """Nodes in page order; by id: characters of text, and of text in links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    size = {id(n): [0.0, 0.0] for n in order}
    for node in reversed(order):
        own = size[id(node)]
        own[0] += sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.tag == "a":
            own[1] = own[0]
        if node.parent is not None and id(node.parent) in size:
            size[id(node.parent)][0] += own[0]
            size[id(node.parent)][1] += own[1]
    return order, size


def _text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        else:
            todo += reversed(k.kids)
    return " ".join("".join(out).split())


def _density(own: list[float]) -> float:
    return own[1] / own[0] if own[0] else 0.0


def _score(order: list[Node], size: dict[int, list[float]]) -> list[Node]:
    """The candidates, in page order, with their points."""
    whole: dict[int, float] = {}
    for node in order:
        holds_blocks = any(not isinstance(k, str) and k.tag in BLOCK and k.tag != "hr" for k in node.kids)
        own_text = node.tag in CONTAINER and any(isinstance(k, str) and k.strip() for k in node.kids)
        if not (node.tag in PARAGRAPH and not holds_blocks) and not own_text:
            continue
        text = _text(node) if not holds_blocks else " ".join(" ".join(k.split()) for k in node.kids if isinstance(k, str))
        if not text:
            continue
        node.paragraph = True
        points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - _density(size[id(node)]))
        first = node if node.tag in CONTAINER else node.parent
        whole[id(first)] = whole.get(id(first), 0.0) + points
    half: dict[int, float] = {}
    rest: dict[int, float] = {}
    candidates = []
    for node in reversed(order):  # every node before its parent
        own, below, far = whole.get(id(node)), half.get(id(node)), rest.get(id(node))
        if own is None and below is None and far is None:
            continue
        own, below, far = own or 0.0, below or 0.0, far or 0.0
        node.points = BONUS.get(node.tag, 0.0) + (25 if node.names and _LIKELY.search(node.names) else 0) + own + below + far
        candidates.append(node)
        if node.parent is not None:
            up = id(node.parent)
            half[up] = half.get(up, 0.0) + own / 2
            rest[up] = rest.get(up, 0.0) + (below + far) / 3
    return candidates[::-1]


def _blocks(nodes: list[Node], size: dict[int, list[float]], trusted: bool = False) -> list[str]:
    """Texts between the borders of blocks, in page order; lists of links go unless what holds them is ``trusted``."""
    out: list[str] = []
    piece: list[str] = []

    def close() -> None:
        if piece:
            if text := " ".join("".join(piece).split()):
                out.append(text)
            piece.clear()

    todo: list = list(reversed(nodes))
    while todo:
        k = todo.pop()
        if k is None:
            close()
        elif isinstance(k, str):
            piece.append(k)
        elif k.tag == "hr":
            close()
        else:
            own = size.get(id(k), [0.0, 0.0])
            if not trusted and k.tag in ("ul", "ol", "div", "section", "table", "dl") and _density(own) > 0.6 and own[0]:
                close()  # a list of links
                continue
            if k.tag in BLOCK:
                close()
                todo.append(None)
            todo += reversed(k.kids)
    close()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, white space squeezed, joined by newlines."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    order, size = _measure(root)
    candidates = _score(order, size)
    if not candidates:
        return "\n".join(_blocks([root], size))
    final = {id(c): c.points * (1 - _density(size[id(c)])) for c in candidates}
    best = max(candidates, key=lambda c: final[id(c)])
    top = final[id(best)]
    # An article element around the best container, or a parent that holds most of the rest, is the container.
    for up in _up(best.parent):
        if up.tag in ("article", "main") or final.get(id(up), 0.0) >= 0.75 * top:
            best = up
            if up.tag in ("article", "main"):
                break
    chosen: list[Node] = []
    for k in best.parent.kids if best.parent is not None and best.tag not in ("body", "main") else [best]:
        if k is best:
            chosen.append(k)
        elif not isinstance(k, str):
            own, density = size[id(k)], _density(size[id(k)])
            bonus = 0.2 * top if k.names and k.names == best.names else 0.0
            if final.get(id(k), 0.0) + bonus >= max(10.0, 0.2 * top) and density < 0.3:
                chosen.append(k)
            elif k.tag == "p" and ((own[0] > 80 and density < 0.25) or (own[0] and density == 0 and re.search(r"[.!?](?:\s|$)", _text(k)))):
                chosen.append(k)
    return "\n".join(_blocks(chosen, size, any(x.tag in ("article", "main") for x in _up(best))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = dict(narrow.dtypes)["page_id"]
    return narrow.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
