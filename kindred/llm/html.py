"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks with the tags that are open around each.  A linear classifier turns a
block's features (tags and class names around it, share of linked text, length, sentence ends) into
costs of calling it content or boilerplate, which become capacities from the source and to the sink.
Blocks that follow each other, and blocks under the same parent or section, are joined by smoothness
edges.  The maximum flow separates the two labels at least cost, and content blocks are joined.

The parser is forgiving: unclosed and crossed tags, missing quotes, cut-off tags and references are
read as browsers read them.  Scripts, styles and other raw text are never blocks.

Defined results: a null or empty html gives an empty text; a page without content gives an empty
text; rows that repeat are read each by itself; other columns pass through and an output column
replaces an input column of its name.  An svg or math element without an end tag is passed over and
the page goes on behind its opening tag.  Reading is linear in the page however deep its tags are
nested: what the open tags say is carried from each tag to the next one inside it.  A block has at
most three edges, and the flow is searched along them.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the markup language: tags whose content is not markup, that have no content, that
#: stand inside a line of text, and what an opening tag closes.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math"}
FOREIGN = {"svg", "math"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var wbr img br".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Tags that end an open paragraph.
BLOCK = set(
    "address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
    "nav ol p pre section summary table ul body html".split()
)
#: Within these, an opening li, td and so on doesn't close one further out.
SCOPES = set("ul ol dl table article section div body html main aside nav header footer form".split())
#: Blocks of these belong to what stands around them.
LEAVES = set("p li td th h1 h2 h3 h4 h5 h6 blockquote pre".split())
SECTIONS = set("article main section aside nav header footer form div table ul ol body".split())

TAG = re.compile(r"<!--.*?(?:--!?>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(>|$)|<[!?/][^>]*(?:>|$)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")

#: The classifier: weights of features, positive towards boilerplate.  Names are matched by whole words.
BOILER_TAGS = {"nav": 9, "footer": 9, "aside": 9, "form": 9, "menu": 9, "button": 9, "select": 9, "fieldset": 9, "header": 7, "dialog": 9, "address": 1, "label": 2, "object": 9, "audio": 9, "video": 9, "canvas": 9}
CONTENT_TAGS = {"article": -4, "main": -3, "p": -1, "pre": -1, "blockquote": -1, "h1": -2, "h2": -1, "h3": -1}
BOILER_NAMES = set(
    "ad ads adv advert advertisement advertising adverts banner sponsor sponsored sponsors promo promoted promotion promotions "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination sidebar side rail aside widget widgets "
    "footer foot copyright legal masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog "
    "subscribe subscription newsletter signup login search share sharing social follow related recommended recommendations trending popular "
    "comment comments commentlist disqus respond replies reply discussion feedback tags tagcloud toc skip disclaimer paywall form outbrain taboola".split()
)
CONTENT_NAMES = set("article articlebody content post entry story body main text prose".split())
BIAS, NAME_BOILER, NAME_CONTENT, LINKED, LONG, ENDED, HEAD = 1.0, 8.0, -3.0, 5.0, -2.5, -0.5, 9.0
#: Smoothness: neighbours in the page, and blocks with the same parent or section.
NEXT_EDGE, PARENT_EDGE = 0.6, 0.9


@dataclass
class Node:
    """An open tag, with what it and the tags around it say together.

    Boilerplate within content counts in full, content within boilerplate for a quarter; but an
    article inside a mere nav or header tag, which was then left open, is an article.
    """

    tag: str = ""
    weight: float = 0.0
    number: int = 0
    parent: Node | None = None

    def __post_init__(self):
        above = self.parent
        total, named = (above.total, above.named) if above else (0.0, False)
        if self.weight >= 5:
            total = max(total, 0.0) + self.weight
            named = named or self.tag not in ("nav", "header", "form")
        elif self.tag in ("article", "main") and not named:
            total = min(total, 0.0) + self.weight
        else:
            total += self.weight if total <= 0 else self.weight / 4
        self.total, self.named = total, named
        self.section = self.number if self.tag in SECTIONS else above.section if above else 0
        #: The outermost tags around the node, itself included.
        self.head = (*above.head, self.number) if above and len(above.head) < 2 else above.head if above else ()


@dataclass
class Block:
    text: str
    linked: int
    node: Node


def _node_weight(tag: str, names: frozenset, hidden: bool, top: bool) -> float:
    """What standing inside this node says; the strongest of tag and names towards boilerplate counts."""
    tag_weight = BOILER_TAGS.get(tag, CONTENT_TAGS.get(tag, 0))
    if tag == "header" and not top:
        tag_weight = 0  # the head of an article holds its title
    name_weight = 0.0
    if tag not in ("body", "html", "article", "main"):
        boiler = names & BOILER_NAMES or (top and names & {"header", "head"} and not names & CONTENT_NAMES)
        if boiler and not (names & CONTENT_NAMES and names & {"with", "has", "no"}):
            name_weight = NAME_BOILER
        elif names & CONTENT_NAMES:
            name_weight = NAME_CONTENT
    if hidden:
        return HEAD
    return max(tag_weight, name_weight) if max(tag_weight, name_weight) > 0 else min(tag_weight, name_weight)


class _Reader:
    """Collects the blocks of one page.

    Of the tags inside a line only links matter, so only they are remembered, with the depth they were
    opened at.  For each tag the places in the stack where it is open are kept, so no tag searches it.
    """

    def __init__(self):
        self.stack: list[Node] = [Node()]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = [0]
        self.links: list[int] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.node: Node | None = None
        self.numbers = 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if text.strip():
            self.node = self.node or self.stack[-1]
            if self.links:
                self.linked += len("".join(text.split()))
        self.parts.append(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, self.node))
            self.parts, self.linked, self.node = [], 0, None

    def _cut(self, k: int) -> None:
        """Close all tags from place ``k`` on, and the links opened within them."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
        while self.links and self.links[-1] > k:
            self.links.pop()

    def open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links.append(len(self.stack))
            return
        self.flush()
        if tag in BLOCK and self.places["p"]:
            self._cut(self.places["p"][-1])
        if tag in CLOSES:
            last = max((self.places[t][-1] for t in CLOSES[tag] if self.places[t]), default=0)
            if last > self.scopes[-1]:
                self._cut(last)
        if tag in VOID:
            return
        found = NAMED.findall(attributes) if attributes else ()
        words = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join("".join(f) for f in found)) if found else ""
        names = frozenset(WORD.findall(words.lower()))
        hidden = bool(attributes) and HIDDEN.search(attributes) is not None
        top = not any(self.places[t] for t in ("article", "main", "section"))
        self.numbers += 1
        weight = _node_weight(tag, names, hidden, top)
        if tag in CONTENT_TAGS and self.places[tag]:
            weight = max(weight, 0.0)  # an article within an article says nothing more
        self.places[tag].append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(Node(tag, weight, self.numbers, self.stack[-1]))

    def close(self, tag: str) -> None:
        """Formatting that was left open goes on behind a block, as in browsers, but not links."""
        if tag in INLINE:
            if tag == "a" and self.links:
                self.links.pop()
            return
        self.flush()
        if self.places[tag]:
            self._cut(self.places[tag][-1])


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    reader, at, low, endless = _Reader(), 0, None, set()
    while True:
        m = TAG.search(page, at)
        if not m:
            reader.text(page[at:])
            break
        reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[4] == "":  # cut off inside a tag
            break
        if m[1]:
            reader.close("p" if tag == "p" else tag)
        elif tag in RAW:
            if tag in FOREIGN and (m[3].endswith("/") or tag in endless):
                continue
            if tag not in INLINE:
                reader.flush()
            low = page.lower() if low is None else low
            low = low if len(low) == len(page) else re.sub("[A-Z]", lambda c: c[0].lower(), page)
            stop = low.find(f"</{tag}", at)
            if stop < 0 and tag in FOREIGN:
                endless.add(tag)
                continue
            if stop < 0:
                break
            stop = page.find(">", stop)
            if stop < 0:
                break
            at = stop + 1
        else:
            if tag == "br":
                reader.parts.append("\n") if reader.parts else None
            reader.open(tag, m[3])
    reader.flush()
    return reader.blocks


def classify(block: Block) -> float:
    """Log-odds of boilerplate."""
    size = len(block.text)
    solid = len("".join(block.text.split()))
    score = BIAS + block.node.total + LINKED * (block.linked / solid if solid else 0.0)
    score += LONG * min(1.0, size / 200) + (ENDED if block.text[-1:] in ".!?\"”»" else 0.0)
    return score


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours of the same section, and along each parent and section."""
    out, last_parent, last_section = [], {}, {}
    for k, b in enumerate(blocks):
        parent = b.node.parent.number if b.node.tag in LEAVES else b.node.number
        section = b.node.section
        if k and b.node.head == blocks[k - 1].node.head:
            out.append((k - 1, k, NEXT_EDGE))
        for last, key in ((last_parent, parent), (last_section, section)):
            if key in last:
                out.append((last[key], k, PARENT_EDGE / 2))
            last[key] = k
    return out


def min_cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut.

    ``costs`` holds for each node the capacities from the source and to the sink.  What both have in
    common flows at once; the rest is sent along shortest augmenting paths level by level.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, (a, b) in enumerate(costs):
        if a > b:
            edge(source, k, a - b, 0.0)
        elif b > a:
            edge(k, sink, b - a, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] <= least)
                del path[first:]
                at = to[path[-1]] if path else source
                continue
            moved = False
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > least and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                    moved = True
                    break
                turn[at] += 1
            if not moved:
                if at == source:
                    break
                e = path.pop()
                at = to[path[-1]] if path else source
                turn[at] += 1


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by line feeds."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    scores = [classify(b) for b in blocks]
    costs = [(max(-s, 0.0), max(s, 0.0)) for s in scores]
    keep = min_cut(costs, _edges(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of each page."""
    return df.withColumn(text, _main_text(F.col(page)))
