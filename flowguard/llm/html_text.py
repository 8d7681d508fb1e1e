"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A classifier gives each block a log-odds of being
content; positive odds are the capacity from the source, negative ones the capacity to the
sink. Neighbouring blocks, and each block and the last one under its nearest
elements, are tied by smoothness edges that weaken with their distance in the tree. The
maximum flow separates content from boilerplate at the least total cost.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded_batches

# Element names of HTML by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe object svg title".split())
#: These run to the end of the page where their end tag is missing.
OPEN_ENDED = frozenset("script style textarea title".split())
PARAGRAPH_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th option tr".split())
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav footer header aside form button select option menu dialog head search fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus discussion footer form header hidden login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
CONTENT_NAMES = frozenset("article body content entry main maincontent post story text".split())

# Words of a class or id that only say how something is laid out.
HOLDERS = frozenset("area bar block blocks box container content group inner item items link links list outer panel row section slot title unit wrap wrapper".split())
NEGATIONS = frozenset("has no is with without not hide".split())

MARK = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME = re.compile(r"[A-Za-z]+")

TAG_ODDS = 8.0
NAME_ODDS = 6.0
INSIDE_ODDS = 4.0
NEAR_TIE = 1.8


@dataclass
class Element:
    """An open element: what it and its ancestors say about the text inside."""

    tag: str
    number: int
    content: float = 0.0
    other: float = 0.0


@dataclass
class Block:
    """A run of text between block-level marks."""

    parent: Element
    above: tuple[int, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _names(value: str) -> tuple[bool, bool]:
    """Whether a class or id names content, and whether it names something else.

    Each token is judged as a whole: its name, its last word, or a first word that only
    layout words follow. Tokens such as ``has-sidebar`` or ``no-comments`` say nothing.
    """
    content = other = False
    for token in value.split():
        words = [w.lower() for w in NAME.findall(token)]
        if not words or words[0] in NEGATIONS:
            continue
        holds = all(w in HOLDERS for w in words[1:])
        other |= words[-1] in OTHER_NAMES or words[0] in OTHER_NAMES and holds
        content |= words[-1] in CONTENT_NAMES or words[0] in CONTENT_NAMES and holds
    return content, other


def _element(tag: str, attributes: str, parent: Element, number: int) -> Element:
    content, other = parent.content, parent.other
    if tag in CONTENT_TAGS:
        content = max(content, INSIDE_ODDS)
    if tag in OTHER_TAGS and not (tag == "header" and parent.content and not parent.other):
        other = max(other, TAG_ODDS)  # the header inside an article holds its headline
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id") and tag not in ("body", "html"):
                says_content, says_other = _names(value)
                if says_other and tag not in CONTENT_TAGS:
                    other = max(other, NAME_ODDS)
                elif says_content:
                    content = max(content, INSIDE_ODDS / 2)
            elif name == "role":
                other = max(other, TAG_ODDS if value in OTHER_ROLES else 0.0)
                content = max(content, INSIDE_ODDS if value in CONTENT_TAGS else 0.0)
            elif name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
                other = max(other, TAG_ODDS)
        if re.search(r"(?:^|\s)hidden(?:\s|$|=|/)", QUOTED.sub('""', attributes)):
            other = max(other, TAG_ODDS)
    return Element(tag, number, content, other)


def page_blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; raw elements such as scripts hold no text."""
    root = Element("", 0)
    stack, blocks, current, at, number, links = [root], [], None, 0, 0, 0
    end = len(page)

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            current = Block(stack[-1], tuple(e.number for e in stack))
            blocks.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while at < end:
        m = MARK.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1], m[2].lower()
        if tag in RAW_TAGS:
            if not closing and not m[3].endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end if tag in OPEN_ENDED else at
            continue
        if tag == "br":
            if current is not None:
                add(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        current, links = None, 0
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
        elif tag not in VOID_TAGS:
            if tag in PARAGRAPH_TAGS and stack[-1].tag in PARAGRAPH_TAGS and (stack[-1].tag == tag or stack[-1].tag[0] in "ph"):
                stack.pop()
            elif stack[-1].tag == "p":
                stack.pop()
            number += 1
            stack.append(_element(tag, m[3], stack[-1], number))
            stack[-1].number = number
    return [b for b in blocks if b.text()]


def content_odds(block: Block, text: str, has_article: bool) -> float:
    """Log-odds that a block is content: fixed weights on tags, names, links, length and punctuation."""
    if block.parent.other:
        return -block.parent.other
    odds = block.parent.content
    if not block.parent.content and has_article:
        odds -= 3.0
    share = block.linked / max(1, sum(map(len, block.parts)))
    odds += 1.0 if len(text) >= 60 else -0.5
    odds += 0.5 if text[-1] in ".!?…»”\"" else -0.3
    odds += 1.2 if block.parent.tag in ("p", "pre", "blockquote", "h1") else 0.0
    return odds - 2.5 * share * (not block.parent.content)


def source_side(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut, by maximum flow over level graphs."""
    n = len(odds)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forward: float, backward: float) -> None:
        head[a].append(len(to)), to.append(b), room.append(forward)
        head[b].append(len(to)), to.append(a), room.append(backward)

    for i, value in enumerate(odds):
        if value > 0:
            link(source, i, value, 0.0)
        else:
            link(i, sink, -value, 0.0)
    for a, b, weight in ties:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(head[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                turn[a] += 1


def tree_distance(a: Block, b: Block) -> int:
    """Steps between two blocks in the tree of elements, by their nearest common ancestor; 1 within one element."""
    shared = 0
    for x, y in zip(a.above, b.above):
        if x != y:
            break
        shared += 1
    return 1 + len(a.above) + len(b.above) - 2 * shared


def main_text(page: str | None) -> str:
    """The content blocks of a page in order, joined by two line ends."""
    blocks = page_blocks(page or "")
    texts = [b.text() for b in blocks]
    has_article = any(b.parent.content and not b.parent.other for b in blocks)
    odds = [content_odds(b, t, has_article) for b, t in zip(blocks, texts)]
    ties, last = [], {}
    for i, block in enumerate(blocks):
        near = {i - 1} if i else set()
        near |= {last[element] for element in block.above[-3:] if element in last}
        ties += [(j, i, NEAR_TIE / tree_distance(blocks[j], block)) for j in sorted(near)]
        last.update(dict.fromkeys(block.above, i))
    side = source_side(odds, ties)
    return "\n\n".join(t for t, keep in zip(texts, side) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page, or one without content, gives the empty text. Repeated rows and
    null ids are extracted alike, and other columns are ignored. White space, also between
    inline elements, becomes one space within a block; line breaks do not end a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    bounded_batches(pages.sparkSession)
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
