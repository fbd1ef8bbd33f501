"""Main text of web pages by a minimum cut.

A page is cut into blocks of text. A linear classifier gives each block what it costs
to call it content and what it costs to call it boilerplate; these are the capacities
to the two terminals. Its features are bounded: length, sentences, links, the block's
own element, and what the elements around it are and are called. Blocks that follow
each other are joined by a smoothness edge, the stronger the nearer their elements lie
in the document's tree, and so are neighbouring children of one element. The minimum
cut, found by maximum flow over the whole page, is the labelling of least cost; content
blocks in page order are the page's text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- blocks ----------------------------------------------------------------------------------------------------------

# Elements that begin and end blocks, have no content, or hold text that isn't shown. Fixed values of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend "
    "li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "textarea", "iframe", "noembed", "noframes")
#: An element that an opening tag ends.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
#: Beyond these, an opening tag ends no element.
SCOPE = frozenset("ul ol dl table select html body div article section main aside form td th".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(" + "|".join(RAW) + r")(?![\w-])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: What only a form around a whole page holds: the page's structure, or most of its paragraphs.
_FORM_END, _STRUCTURE, _PARAGRAPH = (re.compile(x, re.I) for x in (r"</form\b", r"<(?:article|main|nav|header|footer|aside|h1)\b", r"<p\b"))
WRAPPED_PARAGRAPHS = 3
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# --- classifier ------------------------------------------------------------------------------------------------------

#: What an element says against the text in it, by its tag. What is never shown as text counts most.
AGAINST_TAGS = {
    "head": -8.0, "title": -8.0, "nav": -4.5, "footer": -4.5, "aside": -4.5, "form": -4.5, "menu": -4.5, "select": -4.5, "dialog": -4.0, "button": -4.0, "header": -3.0, "label": -2.0, "noscript": -1.5,
}
NOT_SHOWN = -8.0
#: What an article or main element says for it.
WITHIN = 2.5
#: Words of classes, ids and roles: names of what stands beside an article, words that also occur in the names of articles, and names of articles.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget footer masthead "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended "
    "popup modal overlay pagination pager toolbar complementary contentinfo paywall".split()
)
UNSURE_WORDS = frozenset("banner header notice notices alert copyright legal disclaimer search form hidden tags skip".split())
ARTICLE_WORDS = frozenset("article content main post entry story body text".split())
BESIDE, UNSURE, NAMED = -4.0, -2.0, 1.0
#: How much an element keeps of what the elements around it say against it, where it is an article, and where it is named one.
IN_ARTICLE, IN_NAMED = 0.3, 0.75
#: Evidence of a block itself.
BIAS, PER_WORD, MOST_WORDS, SENTENCE, LINKED = -1.0, 0.05, 40, 0.6, -3.0
OWN = {"p": 0.8, "h1": 0.8, "h2": 0.8, "h3": 0.8, "h4": 0.6, "h5": 0.5, "h6": 0.5, "blockquote": 0.8, "pre": 0.8, "figcaption": 0.5, "td": 0.2, "dd": 0.4, "math": 0.6}
#: Smoothness of neighbours, divided by one more than their distance in the tree.
NEXT, SIBLING = 2.4, 1.2


class Block:
    __slots__ = ("tag", "text", "words", "linked", "evidence", "element")

    def __init__(self, tag, text, words, linked, evidence, element):
        self.tag, self.text, self.words, self.linked, self.evidence, self.element = tag, text, words, linked, evidence, element


def _evidence(tag: str, attributes: str, around: float, within: bool) -> float:
    """What an element and those around it say for (over 0) or against (below 0) the text in it being content."""
    own = AGAINST_TAGS.get(tag, 0.0)
    if tag == "header" and within:
        own = 0.0  # the head of an article
    beside = unsure = named = False
    if attributes:
        for name, given in _NAMED.findall(attributes):
            name, given = name.lower(), given.strip("\"'")
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given, re.I):
                    own = NOT_SHOWN
            elif name == "hidden" or name == "aria-hidden" and given.lower() == "true":
                own = NOT_SHOWN
            elif tag not in ("body", "html"):
                words = {x.lower() for x in _PARTS.findall(given)}
                beside |= not words.isdisjoint(BESIDE_WORDS)
                unsure |= not words.isdisjoint(UNSURE_WORDS)
                named |= not words.isdisjoint(ARTICLE_WORDS)
    is_article = tag in ("article", "main")
    if (beside or unsure) and named:
        named = beside = unsure = False  # such as "content with-sidebar": the name decides nothing
    if beside and not is_article or beside and tag == "article" and within:
        own = min(own, BESIDE)
    elif unsure and not is_article:
        own = min(own, UNSURE)
    if own < 0:
        # What stands beside an article does so inside of one too.
        return max(NOT_SHOWN, own + IN_ARTICLE * min(around, 0.0))
    if is_article:
        return WITHIN + IN_ARTICLE * min(around, 0.0)
    if named:
        return around + NAMED if around >= 0 else around * IN_NAMED
    return around


class Forms:
    """Tells a form around a page from one in it, by what stands before its end; places are searched once for a page."""

    def __init__(self, page: str):
        self.ends, self.structure, self.paragraphs = ([m.start() for m in x.finditer(page)] for x in (_FORM_END, _STRUCTURE, _PARAGRAPH))

    def is_wrapper(self, at: int) -> bool:
        k = bisect_left(self.ends, at)
        end = self.ends[k] if k < len(self.ends) else 1 << 62
        held = lambda places: bisect_left(places, end) - bisect_left(places, at)
        n = held(self.paragraphs)
        return held(self.structure) > 0 or n >= WRAPPED_PARAGRAPHS and 2 * n > len(self.paragraphs)


class Page:
    """The blocks of text of a page, in page order, and the tree of its elements: the parent and depth of each."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]
        self._read(page)

    def _read(self, page: str) -> None:
        # Open elements: (tag, evidence, number, within an article, elements of BLOCK up to it), and for each tag where it is open.
        stack: list[tuple[str, float, int, bool, int]] = [("", 0.0, 0, False, 0)]
        open_at: dict[str, list[int]] = {}
        parts: list[str] = []
        link_parts: list[str] = []
        links = 0
        forms: Forms | None = None

        def flush() -> None:
            if parts:
                words = entities.unescape("".join(parts)).split()
                if words:
                    shown = " ".join(words)
                    n_linked = len("".join(entities.unescape("".join(link_parts)).split())) if link_parts else 0
                    own = stack[max((open_at[t][-1] for t in open_at if t in BLOCK and open_at[t]), default=0)][0]
                    self.blocks.append(Block(own, shown, len(words), min(1.0, n_linked / max(1, len(shown) - len(words) + 1)), stack[-1][1], stack[-1][2]))
                parts.clear()
                link_parts.clear()

        def close_to(k: int) -> None:
            nonlocal links
            for tag, *_ in stack[k:]:
                links -= tag == "a"
                open_at[tag].pop()
            del stack[k:]

        def last(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        at = 0
        for m in _TAG.finditer(page):
            if m.start() > at:
                piece = page[at : m.start()]
                parts.append(piece)
                if links > 0:
                    link_parts.append(piece)
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                k = last((tag,))
                if k:
                    if tag in BLOCK:
                        flush()
                    elif stack[-1][4] > stack[k - 1][4]:
                        continue  # an inline end tag doesn't end blocks
                    close_to(k)
                elif tag in ("p", "br"):
                    parts.append(" ")
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCK:
                flush()
                ends = ENDED_BY.get(tag, ())
                scope = SCOPE - {"td", "th"} if ends and tag in ("tr", "tbody", "tfoot") else SCOPE
                j = last(("p", *ends))
                if j and j >= last(scope):
                    close_to(j)
            if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
                continue
            _, around, up, within, n_blocks = stack[-1]
            open_at.setdefault(tag, []).append(len(stack))
            if tag == "form" and forms is None:
                forms = Forms(page)
            wraps = tag == "form" and forms.is_wrapper(at)
            stack.append((tag, around if wraps else _evidence(tag, m[4], around, within), len(self.parent), within or tag in ("article", "main"), n_blocks + (tag in BLOCK)))
            self.parent.append(up)
            self.depth.append(len(stack) - 1)
            links += tag == "a"
        if at < len(page):
            parts.append(page[at:])
            if links > 0:
                link_parts.append(page[at:])
        flush()

    def distance(self, a: int, b: int) -> int:
        """Edges of the tree between two elements."""
        n = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            n += 1
        return n

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness edges: between successive blocks, and between successive blocks among those of one parent."""
        blocks, edges = self.blocks, []
        last: dict[int, int] = {}
        for k, b in enumerate(blocks):
            if k:
                edges.append((k - 1, k, NEXT / (1 + self.distance(blocks[k - 1].element, b.element))))
            up = self.parent[b.element] if b.element else -1
            if (j := last.get(up)) is not None and j < k - 1:
                edges.append((j, k, SIBLING / (1 + self.distance(blocks[j].element, b.element))))
            last[up] = k
        return edges


def costs(block: Block) -> float:
    """How much dearer it is to call a block boilerplate than content."""
    value = BIAS + block.evidence + OWN.get(block.tag, 0.0) + PER_WORD * min(block.words, MOST_WORDS) + LINKED * block.linked
    return value + SENTENCE * block.text.endswith((".", "!", "?", "…", "。"))


# --- minimum cut -----------------------------------------------------------------------------------------------------


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it lies on the source's side of a minimum cut, by augmenting shortest paths in layers.

    terminal[k] over 0 is the capacity from the source to k, below 0 that from k to the sink; edges have a capacity both ways."""
    n = len(terminal)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, c in enumerate(terminal):
        if c > 0:
            join(source, k, c, 0.0)
        elif c < 0:
            join(k, sink, -c, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        next_ = [0] * len(out)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, a = [], source
                continue
            while next_[a] < len(out[a]):
                e = out[a][next_[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            else:
                if not path:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]
    return [x >= 0 for x in level[:n]]


def labelled(page: str) -> list[tuple[Block, float, bool]]:
    """(block, what its own costs say, whether the cut calls it content) of a page."""
    read = Page(page)
    terminal = [costs(b) for b in read.blocks]
    return list(zip(read.blocks, terminal, minimum_cut(terminal, read.edges())))


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null and for pages without any."""
    return "\n\n".join(b.text for b, _, good in labelled(page) if good) if page else ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page and its code points. Null and empty pages have an empty text; null ids and urls stay; repeated rows repeat; an empty table gives an empty result."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)
