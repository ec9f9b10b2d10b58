"""Main text of web pages by minimum cut: each block of a page is content or boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- markup (fixed values of the HTML standard) -------------------------------------------------------

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose text is never part of a page's prose.
SILENT = frozenset("script style title textarea iframe noembed noframes noscript template svg select datalist option button "
                   "canvas audio video object map".split())
BLOCK = frozenset("address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section "
                  "summary table tbody td tfoot th thead tr ul xmp".split())
#: Blocks of this kind hold a text; their neighbours are the other children of their parent.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption legend summary".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSES_P = BLOCK - frozenset("caption legend optgroup option tbody td tfoot th thead tr".split())
TABLE = ("table", "template", "object")
CELL = (*TABLE, "td", "th", "caption")
#: An open element of these names ends where another begins, unless one of the last names is open inside it.
ENDS = {
    "li": (("li",), (*CELL, "ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), (*CELL, "dl")), "dt": (("dd", "dt"), (*CELL, "dl")),
    "td": (("td", "th"), TABLE), "th": (("td", "th"), TABLE), "tr": (("tr",), TABLE), "a": (("a",), CELL),
    **{name: (("thead", "tbody", "tfoot", "caption"), TABLE) for name in ("thead", "tbody", "tfoot")},
    "option": (("option",), ("select", "datalist")),
}
TAG = re.compile(r"""<(?:
    (?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)
    (?P<attributes>(?:[^>"'=]++ | =\s*+(?:"[^"]*+(?:"|\Z) | '[^']*+(?:'|\Z) | [^\s>"']?) | ["'])*+)(?P<closed>>|\Z)
    | !--(?:-?>|.*?(?:--!?>|\Z)) | [!?/][^>]*+(?:>|\Z))""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# --- the classifier: log-odds that a block is content ---------------------------------------------------

NAV, ASIDE, FOOTER, HEADER, FORM, DIALOG, UNLIKELY, HIDDEN, ARTICLE, MAIN, LIKELY, SILENCED = (1 << k for k in range(12))
AGAINST = NAV | ASIDE | FOOTER | HEADER | FORM | DIALOG | UNLIKELY | HIDDEN
OF_TAG = {"nav": NAV, "menu": NAV, "aside": ASIDE, "footer": FOOTER, "header": HEADER, "form": FORM, "fieldset": FORM, "search": FORM,
          "dialog": DIALOG, "article": ARTICLE, "main": MAIN}
OF_ROLE = {"navigation": NAV, "menu": NAV, "menubar": NAV, "toolbar": NAV, "banner": HEADER, "contentinfo": FOOTER, "complementary": ASIDE,
           "search": FORM, "form": FORM, "dialog": DIALOG, "alertdialog": DIALOG, "alert": DIALOG, "main": MAIN, "article": ARTICLE}
UNLIKELY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs byline comment commentlist comments consent "
    "cookie cookies copyright disclaimer disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination paywall popup promo promotion promotions recommended related replies reply respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar trending warning widget widgets".split())
LIKELY_WORDS = frozenset("article body content entry main post story text".split())
#: After one of these, a word names what a page has or lacks, not what the element is.
MODIFIERS = frozenset("with has have no without hide show".split())
WEIGHTS = {NAV: -6.0, ASIDE: -5.0, FOOTER: -6.0, HEADER: -4.0, FORM: -5.0, DIALOG: -5.0, UNLIKELY: -6.0, HIDDEN: -7.0, ARTICLE: 3.0, MAIN: 2.0,
           LIKELY: 1.5}
OF_LEAF = {**dict.fromkeys(HEADINGS, 0.5), "p": 1.0, "pre": 1.0, "blockquote": 1.0, "li": -0.25, "td": -0.25, "th": -0.5}
LINKS, SENTENCE, OUTSIDE, SIGN, LENGTH = -5.0, 0.5, -2.5, -3.0, (-1.0, 2.0)
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")

#: Smoothness: neighbours in page order, neighbours below one parent with others between, and the distance
#: (elements to leave and enter) past which all neighbours count as equally far.
ADJACENT, SIBLING, FAR = 1.0, 0.5, 8


class Block(NamedTuple):
    """A stretch of text without a block boundary; ``container`` is a number among the page's elements."""

    text: str
    linked: int
    tag: str
    mask: int
    container: int


class Page(NamedTuple):
    blocks: list[Block]
    parents: list[int]
    depths: list[int]


def hints(attributes: str) -> int:
    """What class, id, role, style and hidden marks say of an element."""
    mask = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            mask |= HIDDEN
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            mask |= HIDDEN
        elif name == "role":
            mask |= OF_ROLE.get(value.strip().lower(), 0)
        elif name in ("class", "id"):
            for item in value.split():
                words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", item)]
                # Words may be written in one or in two parts: sidebar, side-bar, sideBar.
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    if (word in UNLIKELY_WORDS or word + after in UNLIKELY_WORDS) and before not in MODIFIERS:
                        mask |= UNLIKELY
                    elif word in LIKELY_WORDS:
                        mask |= LIKELY
    return mask


class Reader:
    """Blocks of pages. Follows the standard where it matters for text: character references, comments, raw text,
    end tags that may be left out, end tags without a start. Linear in the page's length."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hints(self, attributes: str) -> int:
        found = self.known.get(attributes)
        if found is None:
            if len(self.known) > 10_000:
                self.known.clear()
            found = self.known[attributes] = hints(attributes)
        return found

    def read(self, page: str) -> Page:
        self.blocks, self.parents, self.depths = [], [-1], [0]
        # Open elements as (name, mask, element number), and where each name is open.
        self.stack, self.open = [("", 0, 0)], defaultdict(list)
        self.buffer, self.linked = [], 0
        at = 0
        while True:
            tag = TAG.search(page, at)
            stop = tag.start() if tag else len(page)
            if stop > at:
                self._text(page[at:stop])
            if tag is None:
                break
            at = tag.end()
            if tag["name"] is None or not tag["closed"]:
                continue
            name = tag["name"].lower()
            if tag["end"]:
                self._end(name)
                continue
            self._start(name, tag["attributes"])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                inside = page[at : close.start()] if close else page[at:]
                if name == "xmp":
                    self._text(inside, decode=False)
                at = close.start() if close else len(page)
        self._flush()
        return Page(self.blocks, self.parents, self.depths)

    def _text(self, text: str, decode: bool = True) -> None:
        if self.stack[-1][1] & SILENCED:
            return
        if decode and "&" in text:
            text = html.unescape(text)
        self.buffer.append(text)
        if self.open["a"]:
            self.linked += len("".join(text.split()))

    def _flush(self) -> None:
        """What was read since the last boundary is a block of the innermost open block element."""
        text = " ".join("".join(self.buffer).split())
        if text:
            name, mask, number = self.stack[self.open["#block"][-1]] if self.open["#block"] else self.stack[0]
            leaf = name in LEAF
            self.blocks.append(Block(text, self.linked, name if leaf else "", mask, self.parents[number] if leaf else number))
        self.buffer, self.linked = [], 0

    def _in_scope(self, name: str, barriers: tuple[str, ...]) -> bool:
        return bool(self.open[name]) and self.open[name][-1] > max((self.open[b][-1] for b in barriers if self.open[b]), default=0)

    def _pop(self, size: int) -> None:
        """Close all elements from place ``size`` of the stack on."""
        while len(self.stack) > size:
            name, _, number = self.stack.pop()
            self.open[name].pop()
            if number >= 0:
                self.open["#block"].pop()

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "head", "body"):
            self._flush()
            return
        if name in ("br", "wbr"):
            if name == "br":
                self._text(" ")
            return
        own = OF_TAG.get(name, 0) | (self._hints(attributes) if attributes and attributes != "/" else 0)
        if name in SILENT:
            own |= SILENCED
        # An inline element that says something of its text is a boundary too.
        block = name in BLOCK or bool(own & ~LIKELY)
        if block:
            self._flush()
        if name in CLOSES_P and self._in_scope("p", (*CELL, "button")):
            self._pop(self.open["p"][-1])
        for other in ENDS.get(name, ((), ()))[0]:
            if self._in_scope(other, ENDS[name][1]):
                self._pop(self.open[other][-1])
        if name in VOID:
            return
        mask = self.stack[-1][1]
        if name == "header" and mask & (ARTICLE | MAIN):
            own &= ~HEADER
        # The nearest word counts: content may stand in a form that is the whole page, boilerplate inside an article.
        if own & MAIN:
            own, mask = own & ~UNLIKELY, mask & ~(FORM | HEADER | UNLIKELY)
        elif own & ARTICLE and not own & AGAINST:
            mask &= ~(FORM | HEADER)
            own &= ~(ARTICLE if mask & AGAINST else 0)
        elif own & AGAINST:
            mask &= ~(ARTICLE | MAIN | LIKELY)
            own &= ~(ARTICLE | LIKELY)
        number = -1
        if block:
            number = len(self.parents)
            parent = self.stack[self.open["#block"][-1]][2] if self.open["#block"] else 0
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.open["#block"].append(len(self.stack))
        self.open[name].append(len(self.stack))
        self.stack.append((name, mask | own, number))

    def _end(self, name: str) -> None:
        if name in BLOCK or name in SILENT:
            names = HEADINGS if name in HEADINGS else (name,)
            barriers = TABLE if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else () if name in TABLE else CELL
            barriers += ("button",) if name == "p" else ("ul", "ol", "menu", "dir") if name == "li" else ()
            self._flush()
            for other in names:
                if self._in_scope(other, barriers):
                    self._pop(self.open[other][-1])
                    return
        elif self.open[name]:
            # Other end tags reach no further than the innermost block.
            at, inner = self.open[name][-1], self.open["#block"][-1] if self.open["#block"] else 0
            if at >= inner:
                if at == inner:
                    self._flush()
                self._pop(at)


def log_odds(block: Block, has_main: bool) -> float:
    """The classifier: above 0 a block by itself is rather content."""
    chars = len(block.text)
    score = sum(w for bit, w in WEIGHTS.items() if block.mask & bit) + OF_LEAF.get(block.tag, 0.0)
    score += min(max(math.log2(chars / 20) / 2, LENGTH[0]), LENGTH[1])
    score += LINKS * min(1.0, block.linked / max(1, chars - block.text.count(" ")))
    if SENTENCE_END.search(block.text):
        score += SENTENCE
    if has_main and not block.mask & (ARTICLE | MAIN):
        score += OUTSIDE
    if block.text[0] == "©":
        score += SIGN
    return score


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """Edges (block, block, weight): neighbours, weaker the more elements lie between, and the last block before it of the
    same parent."""
    def distance(a: int, b: int) -> int:
        steps = 0
        while a != b and steps < FAR:
            if page.depths[a] >= page.depths[b]:
                a = page.parents[a]
            else:
                b = page.parents[b]
            steps += 1
        return steps

    edges, last = [], {}
    for k, block in enumerate(page.blocks):
        if k:
            edges.append((k - 1, k, ADJACENT / (1 + distance(page.blocks[k - 1].container, block.container))))
        before = last.get(block.container)
        if before is not None and before < k - 1:
            edges.append((before, k, SIBLING))
        last[block.container] = k
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the scores lost plus the weights of edges between unlike labels.

    A node with a score s > 0 hangs on the source by s, one with s < 0 on the sink by -s. Nodes whose score
    outweighs all their edges are settled first, which no cut can better, and hand their edges' weights on to their
    neighbours' scores; a maximum flow of shortest augmenting paths separates the others. Ties are boilerplate."""
    scores = list(scores)
    near: list[dict[int, float]] = [{} for _ in scores]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * len(scores)
    todo = list(range(len(scores)))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(scores[i]) > sum(near[i].values()) + 1e-9:
            label[i] = scores[i] > 0
            for j, w in near[i].items():
                scores[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
    content = _max_flow(scores, near, [i for i, x in enumerate(label) if x is None])
    return [i in content if x is None else x for i, x in enumerate(label)]


def _max_flow(scores: list[float], near: list[dict[int, float]], nodes: list[int]) -> set[int]:
    """The source's side of a minimum cut over ``nodes``: those a residual path reaches from the source.

    In each phase nodes get their distance from the source's spare nodes, and depth-first walks push flow along
    rising distances until none reaches the sink. ``near`` holds residual capacities between nodes, both ways."""
    spare = {i: scores[i] for i in nodes if scores[i] > 1e-9}
    room = {i: -scores[i] for i in nodes if scores[i] < -1e-9}
    while True:
        level = dict.fromkeys((i for i, x in spare.items() if x > 1e-9), 0)
        queue, reached = deque(level), False
        while queue:
            i = queue.popleft()
            reached = reached or room.get(i, 0.0) > 1e-9
            for j, w in near[i].items():
                if w > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return set(level)
        arcs = {i: iter(list(near[i])) for i in level}
        for start in [i for i, k in level.items() if k == 0]:
            path = [start]
            while path and spare[start] > 1e-9:
                i = path[-1]
                if room.get(i, 0.0) > 1e-9:
                    push = min([spare[start], room[i], *(near[a][b] for a, b in zip(path, path[1:]))])
                    spare[start] -= push
                    room[i] -= push
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= push
                        near[b][a] += push
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if near[a][b] <= 1e-9), len(path) - 1)
                    # Walk on from the first full arc, or from the end if that still has room.
                    arcs.update({a: iter(list(near[a])) for a in path[full : full + 1]})
                    path = path[: full + 1]
                    continue
                step = next((j for j in arcs[i] if level.get(j) == level[i] + 1 and near[i][j] > 1e-9), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def main_blocks(page: str, reader: Reader | None = None) -> list[str]:
    """Texts of a page's content blocks, in page order."""
    read = (reader or Reader()).read(page)
    has_main = any(b.mask & (ARTICLE | MAIN) for b in read.blocks)
    scores = [log_odds(b, has_main) for b in read.blocks]
    return [b.text for b, kept in zip(read.blocks, minimum_cut(scores, smoothness(read))) if kept]


def extract(pages: DataFrame, column: Column | str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each page, ``n_chars``, its code points, and ``n_blocks``, the content blocks it
    was joined from; these replace columns of those names.

    White space (of any script, no-break spaces too) inside a block becomes one space, blocks are trimmed and joined
    by one space in page order. Null and empty pages, and those without content, give an empty text. Text without any
    markup is one block. Markup cut off inside a tag ends there; whole pages are read, whatever their length, and each
    row by itself: equal rows come out equal, nothing is shuffled."""

    @F.arrow_udf("struct<text: string, n_blocks: int>")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for column in columns:
            texts, counts = [], []
            for cell in column:
                found = main_blocks(cell.as_py() or "", reader)
                texts.append(" ".join(found))
                counts.append(len(found))
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["text", "n_blocks"])

    held = F.col(column) if isinstance(column, str) else column
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "n_blocks")]
    row = F.struct(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)]) if kept else F.lit(0)
    found = pages.select(row.alias("row"), of(held).alias("found"))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "found.text",
                        F.length("found.text").cast("long").alias("n_chars"), "found.n_blocks")
