"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass classifies every block by itself:
stop-word density, length and link density say good, bad or undecided (too short, or long without
stop words). The second pass gives undecided blocks the label of their nearest decided neighbours in
the same container. Containers that hold no article text (menus, footers, forms, adverts, comments)
are bad as a whole, and if a page marks an article, so is everything outside of it. Pages are read by
a scanner that passes every position once, however broken the markup is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluiceway.llm.common import quoted

SHORT_CHARS = 70
LONG_CHARS = 200
STOP_DENSITY = 0.3
LINK_DENSITY = 0.33

# Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    "the of and to a in is it that for on was with as are be this by at from or an not have he she "
    "they we you his her its their which will would can has had were been but all one there "
    "der die und das den dem des ein eine einer eines einem einen von mit für auf ist im nicht sich "
    "auch als an es zu aus bei nach sie er wir ihr wie oder aber wird sind war "
    "le la les de des du et un une est que qui dans en pour par sur au aux avec ce se il elle pas ne "
    "plus ou sont nous vous leur mais comme "
    "el los las del y un una es en por con para su se lo al más como pero sus ya muy sin sobre "
    "il lo gli di della che è per non una sono con si dei da nel alla "
    "o os as do da dos das em um uma não no na com mais foi ao "
    "het een van dat niet zijn op te voor met".split()
)

# Elements whose content is no text: those of the first kind leave nothing between the words around them.
_RAW = frozenset("script style noscript template".split())
_RAW_APART = frozenset("title textarea iframe svg math object canvas select button".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in (*_RAW, *_RAW_APART)}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_HINT = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_SENTENCE_END = re.compile(r"[.!?\u2026\u0964\u061f](?=\s|$|[\"'\u00bb\u201d)])|[\u3002\uff01\uff1f]")

_ARTICLE = frozenset({"article", "main"})
_NEVER = frozenset({"nav", "footer", "aside", "form", "dialog", "menu"})
_CONTAINERS = _ARTICLE | _NEVER | frozenset({
    "header", "div", "section", "ul", "ol", "dl", "table", "figure", "body", "fieldset", "details",
    "blockquote", "span", "a",
})
_BLOCKS = _CONTAINERS - {"span", "a"} | frozenset({
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "caption", "pre",
    "hr", "figcaption", "address", "head", "html", "center", "tbody", "thead", "summary",
})
# Words of class, id and role that mark what is no article text.
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond login "
    "search pagination pager widget toolbar copyright masthead complementary contentinfo dialog "
    "hidden".split()
)


# Words of names that only say where or what kind of box an element is.
_LAYOUT_NAMES = frozenset(
    "box block area wrap wrapper container inner outer content section list item items row col column "
    "top bottom left right main page site post article bar link links button text title header body "
    "panel module component group unit slot placeholder large small mobile desktop".split()
)
_FINE, _LOWERED, _BAD = 0, 1, 2


@dataclass
class _Block:
    container: int
    state: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


def _state(attributes: str, in_article: bool) -> int:
    """What class, id, role and visibility say of an element.

    In an article a name is bad only if each of its parts is a bad or a layout word; one that merely
    has a bad part lowers the labels of its blocks.
    """
    out = _FINE
    for name, value in _HINT.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return _BAD
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                return _BAD
        else:
            for token in value.split():
                parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
                if any(x in _BAD_NAMES for x in parts):
                    if not in_article or all(x in _BAD_NAMES or x in _LAYOUT_NAMES for x in parts):
                        return _BAD
                    out = _LOWERED
                if not in_article and "header" in parts:
                    return _BAD
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: texts ("text", "", text), tags ("open" or "close", name,
    attributes) and ("gap", "", "") for dropped content that stands apart from the words around it.

    Every position is passed once. A tag ends at the first ``>`` outside of quotes. If a page turns out
    to have a quote that is never closed, from there on quotes don't count. A tag, comment or element
    without end takes the rest of the page.
    """
    at, quotes = 0, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            at = end + 3
            continue
        name = _NAME.match(page, start)
        if name is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                if end < 0:
                    return
                at = end + 1
            else:
                yield "text", "", "<"
                at = start + 1
            continue
        end = _tag_end(page, name.end()) if quotes else None
        if end is None:
            quotes = False
            end = page.find(">", name.end())
            if end < 0:
                return
        at = end + 1
        low = name.group(1).lower()
        if page[start + 1] == "/":
            yield "close", low, ""
            continue
        attributes = page[name.end() : end]
        if low in _RAW_END and not (low in ("svg", "math", "object") and attributes.endswith("/")):
            close = _RAW_END[low].search(page, at)
            if low in _RAW_APART:
                yield "gap", "", ""
            if close is None:
                return
            at = close.end()
            continue
        yield "open", low, attributes


def _tag_end(page: str, at: int) -> int | None:
    """Where the ``>`` of a tag stands; None if a quote or the page ends before."""
    while True:
        found = _QUOTE_OR_END.search(page, at)
        if found is None:
            return None
        if found.group() == ">":
            return found.start()
        close = page.find(found.group(), found.end())
        if close < 0:
            return None
        at = close + 1


def blocks(page: str) -> tuple[list[_Block], bool]:
    """Blocks with text in page order, and whether the page marks an article."""
    out: list[_Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, state, article number (0: outside)
    depths: dict[str, list[int]] = {}  # where the open containers of each name are
    articles, link = 0, -1  # link: depth at which the open link began
    state, inside = _FINE, 0
    block = _Block(0, _FINE)
    for kind, name, rest in tokens(page):
        if kind == "text":
            text = html.unescape(rest)
            block.pieces.append(text)
            if link >= 0:
                block.linked += len(" ".join(text.split()))
            continue
        closing = kind == "close"
        if kind == "gap" or name == "br":
            block.pieces.append(" ")
            continue
        if name == "a":
            link = -1 if closing else len(stack)
        elif name in _CONTAINERS:
            if closing:
                if depths.get(name):
                    depth = depths[name][-1]
                    for gone, _, _ in stack[depth:]:
                        depths[gone].pop()
                    del stack[depth:]
                    if link > depth:  # a link ends with the container it began in
                        link = -1
            elif not rest.endswith("/"):
                within = inside
                if name in _ARTICLE:
                    if not within:  # an article also ends what was left open before it
                        articles += 1
                        within = articles
                    low = _state(rest, True)
                else:
                    low = max(state, _state(rest, bool(within)))
                    if name in _NEVER or (name == "header" and not within):
                        low = _BAD
                depths.setdefault(name, []).append(len(stack))
                stack.append((name, low, within))
            state, inside = (stack[-1][1], stack[-1][2]) if stack else (_FINE, 0)
        if name in _BLOCKS or state != block.state or inside != block.container:
            if block.pieces:
                out.append(block)
            block = _Block(inside, state)
    if block.pieces:
        out.append(block)
    return out, articles > 0


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _prose(text: str) -> str:
    """Label of a long block without known stop words, by its script and its sentences.

    Sentences of a usual length in a script other than Latin are text; in Latin script, which the
    lists cover best, they leave the block undecided. Without sentences it is no text.
    """
    words = _WORD.findall(text)
    ends = len(_SENTENCE_END.findall(text))
    letters = sum(map(len, words))
    if not letters or not ends or not 8 <= letters / ends <= 300 or letters < 0.6 * len(text):
        return "bad"
    return "good" if sum(len(_LATIN.findall(w)) for w in words) < 0.5 * letters else "open"


def extract(page: str | None) -> str:
    """The article's blocks, joined by a line feed; empty if there are none."""
    if not page:
        return ""
    found, marked = blocks(page)
    kept: list[tuple[str, int, str]] = []  # text, container, label
    for block in found:
        text = " ".join("".join(block.pieces).split())
        if not text:
            continue
        if block.state == _BAD or (marked and not block.container):
            label = "bad"
        elif block.linked > LINK_DENSITY * len(text):
            label = "bad"
        elif len(text) < SHORT_CHARS:
            label = "open"
        elif _stop_density(text) >= STOP_DENSITY:
            label = "good"
        elif block.container or len(text) < LONG_CHARS:
            label = "open"
        else:
            label = _prose(text)
        if block.state == _LOWERED:
            label = {"good": "open"}.get(label, "bad")
        kept.append((text, block.container, label))
    return "\n".join(t for t, label in zip((k[0] for k in kept), _settle(kept), strict=True)
                     if label == "good")


def _settle(found: list[tuple[str, int, str]]) -> list[str]:
    """Labels after the second pass: equal nearest decided neighbours, else the nearer one.

    Bad containers don't count as neighbours of an article's blocks. Without a decided neighbour in
    its container a block is good inside an article and bad elsewhere.
    """
    labels = [label for _, _, label in found]
    before: list[tuple[str, int] | None] = [None] * len(found)
    after: list[tuple[str, int] | None] = [None] * len(found)
    for side, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last: dict[int, tuple[str, int]] = {}
        for i in order:
            container, label = found[i][1], found[i][2]
            side[i] = last.get(container)
            if label == "good" or (label == "bad" and not container):
                last[container] = (label, i)
    for i, (_, container, label) in enumerate(found):
        if label == "open":
            near = [x for x in (before[i], after[i]) if x is not None]
            if not near:
                labels[i] = "good" if container else "bad"
            elif len({x[0] for x in near}) == 1:
                labels[i] = near[0][0]
            else:
                labels[i] = min(near, key=lambda x: (abs(x[1] - i), x[0] == "bad"))[0]
    return labels


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            [*batch.schema.names[:-1], "text", "n_chars"])


def main_text(pages: DataFrame, html_col: str = "html",
              keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Row by row: the ``keep`` columns, text and n_chars (code points). Nothing is shuffled.

    A null page counts as empty. Unclosed comments and elements without text content end the text; open
    containers don't. Repeated rows give equal rows. Very long pages take time in proportion.
    """
    columns = [c for c in keep if c not in ("text", "n_chars")]
    read = pages.select(*[quoted(c) for c in columns],
                        F.coalesce(quoted(html_col), F.lit("")).alias("_page_html"))
    fields = StructType(read.schema.fields[:-1]).add("text", "string").add("n_chars", "long")
    return read.mapInArrow(_run, fields)
