"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser turns a page into lines, one for each run of text between block-level
tags, with the number of tags met inside it. A line's text-to-tag ratio is its characters over its
tags. The ratios are smoothed with a Gaussian in page order, and lines whose smoothed ratio reaches the
spread of all (or their mean, if that is less) form the content clusters. The clusters vote, by their
characters, for the element that holds the article: the ``article`` or ``main`` with most votes, or else
the deepest container that holds most of them all. Its lines are the text.

Elements that hold no article by what HTML says of them (``nav``, ``footer``, ``aside``, ``form`` and the
like, hidden ones) are left out. So are containers whose class, id or role is mostly made of words such as
``advert`` or ``comments``, unless the clusters show that they hold an ``article`` or most of the content; such
words on a paragraph, heading or inline element count only where no cluster reaches it, or links fill it.
Ratios choose regions only: a short paragraph inside the article stays.

Work and memory are linear in a page, however deep its elements are nested.

Defined results: null, empty and tag-only pages give an empty text; broken markup is read to the end
of the page; a comment ends as in browsers, at the page's end if nothing closes it, and opens in no script,
style, title, textarea or attribute; ``<![`` of any kind is a comment up to the next ``>``; a character reference that is cut off stays as written; rows that repeat are
each extracted; a page_id or url may be null; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import lean, ship, small_batches

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
NO_TEXT = frozenset("head title script style noscript template iframe object svg math canvas audio video map datalist".split())
APART = frozenset("nav footer aside form button select textarea fieldset dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph, and elements that are closed by the next of their kind.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Words in class, id and role that mark what is no part of an article.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright
    disclaimer footer gdpr login masthead menu menus modal nav navbar navigation navigator newsletter notice notices notification pager paginate pagination
    popup promo promoted promotion recommendation recommendations recommended related rss search share sharing shares sidebar signup skip skyscraper
    social sponsor sponsored subscribe subscription toolbar tooltip widget""".split()
)
#: Words that mark what readers wrote, which may be longer than the article.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that say nothing of the content, but often stand beside a mark.
NEUTRAL = frozenset(
    """area articles bar block body bottom box boxes button buttons col column container content entries entry form group header holder icon icons inner item items
    layout left link links list main message module outer page panel post posts recent right row section site small space text top wrap wrapper""".split()
)
_TAG = re.compile(r"<[a-zA-Z/!?]")
_COMMENT_END = re.compile(r"--(?:!|\s*)>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

SIGMA, REACH = 1.0, 2
_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
#: Share of the votes that a container must hold to be entered.
MOST = 0.7


class Line:
    __slots__ = ("parts", "tags", "node", "apart", "article", "heading", "linked")

    def __init__(self, node: int, apart: bool, article: int, heading: bool):
        self.parts, self.tags, self.node, self.apart, self.article, self.heading, self.linked = [], 1, node, apart, article, heading, 0


def marked(value: str) -> str:
    """"readers" or "other" if most words of a class, id or role mark what is no article, else an empty string."""
    words = [w for w in (x.lower() for x in _WORD.findall(value)) if len(w) > 2 or w in MARKS]
    known = sum(w in MARKS or w in READERS or w in NEUTRAL for w in words)
    if 2 * known <= len(words):
        return ""
    return "readers" if READERS.intersection(words) else "other" if MARKS.intersection(words) else ""


class _Events(HTMLParser):
    """Lines of a page, in page order. Containers and marked elements are nodes of a tree, kept by their parents."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool, int]] = []  # tag, node, apart, node of the article around it
        self.within: Counter[str] = Counter()  # how many of a tag are open
        self.parent, self.marks = [0], {}  # of nodes (0: the page); kind of mark, and whether a container has it
        self.fresh, self.tags, self.links = True, 0, 0
        self.pages = {0}  # nodes of html and body elements
        self.at, self.unclosed = 0, set()  # place of the start tag; tags that nothing closes behind it

    def parse_starttag(self, i: int) -> int:
        self.at = i
        return super().parse_starttag(i)

    def set_cdata_mode(self, elem: str) -> None:
        if elem in ("title", "textarea"):  # one that is never closed does not hold the rest of the page
            if elem not in self.unclosed and not re.compile(rf"</\s*{elem}\s*>", re.I).search(self.rawdata, self.at):
                self.unclosed.add(elem)
            if elem in self.unclosed:
                return
        super().set_cdata_mode(elem)

    def parse_comment(self, i: int, report: int = 1) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def _pop(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for x in self.open[k:]:
            self.within[x[0]] -= 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in VOID:
            if tag == "br" and self.lines and not self.fresh:
                self.lines[-1].parts.append(" ")
            elif tag == "hr":
                self.fresh = True
            return
        if tag not in INLINE:
            self.fresh = True
            if any(x[0] == "p" for x in self.open[-4:]):
                self._close("p", 4)
        elif tag in ("td", "th") and self.lines and not self.fresh:
            self.lines[-1].parts.append(" ")
        for other in SELF_CLOSING.get(tag, ()):
            if self.open and self.open[-1][0] == other:
                self._pop(-1)
        if tag in ("article", "main"):  # whatever was left open around it ends here
            while self.open and self.open[-1][2] and self.open[-1][0] not in ("article", "main"):
                self._pop(-1)
        _, node, apart, article = self.open[-1] if self.open else ("", 0, False, 0)
        page, container = tag in ("html", "body"), tag not in INLINE and tag not in HEADINGS and tag != "p"
        mark, hidden = "", False
        for name, value in attrs:
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(value) and "display:none" in value.replace(" ", "").lower()
            if value and not page and name in ("class", "id", "role"):
                mark = max(mark, marked(value))  # readers come after others
        if tag in ("article", "main") and mark != "readers":
            mark = ""
        if container or mark:
            self.parent.append(node)
            node = len(self.parent) - 1
            if mark:
                self.marks[node] = mark, container
        if page:
            self.pages.add(node)
            apart = False
        else:
            apart = apart or hidden or tag in NO_TEXT or tag in APART or tag == "header" and not article
        self.open.append((tag, node, apart, node if tag in ("article", "main") else article))
        self.within[tag] += 1

    def _close(self, tag: str, depth: int) -> None:
        if self.within[tag]:
            for k in range(len(self.open) - 1, max(-1, len(self.open) - 1 - depth), -1):
                if self.open[k][0] == tag:
                    self._pop(k)
                    return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in INLINE:
            self.fresh = True
        elif tag in ("td", "th") and self.lines and not self.fresh:
            self.lines[-1].parts.append(" ")
        if tag not in VOID:
            self._close(tag, len(self.open))

    def handle_data(self, data: str) -> None:
        if not data.strip():
            if self.lines and not self.fresh:
                self.lines[-1].parts.append(" ")
            return
        if self.fresh or not self.lines:
            _, node, apart, article = self.open[-1] if self.open else ("", 0, False, 0)
            heading = any(x[0] in HEADINGS for x in self.open[-3:])
            apart = apart or bool(article) and not heading and self.within["header"] > 0
            self.lines.append(Line(node, apart, article, heading))
            self.fresh = False
            self.tags, seen = 0, self.tags
            self.lines[-1].tags += seen
        line = self.lines[-1]
        line.tags += self.tags
        self.tags = 0
        line.parts.append(data)
        if self.links:
            line.linked += len(data)


def smoothed(values: Sequence[float]) -> list[float]:
    """The values in order, smoothed with a Gaussian that is cut off at REACH and at both ends."""
    out, n = [], len(values)
    for i in range(n):
        lo, hi = max(0, i - REACH), min(n, i + REACH + 1)
        weights = _KERNEL[lo - i + REACH : hi - i + REACH]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def clusters(chars: Sequence[int], tags: Sequence[int]) -> list[bool]:
    """Which lines are content: smoothed text-to-tag ratio against the spread of all, or their mean if that is less."""
    ratios = smoothed([c / t for c, t in zip(chars, tags)])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= min(spread, mean) for r in ratios]


def _summed(values: dict[int, int], parent: Sequence[int]) -> list[int]:
    """Of each node, the values of all nodes below it and its own; a child's number is above its parent's."""
    out = [0] * len(parent)
    for k, v in values.items():
        out[k] = v
    for k in range(len(parent) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def _below(tops: set[int], parent: Sequence[int]) -> list[bool]:
    """Whether a node is one of the tops or below one."""
    out = [0 in tops] * len(parent)
    for k in range(1, len(parent)):
        out[k] = k in tops or out[parent[k]]
    return out


def _left_out(parser: _Events, lines: list[tuple[Line, str, bool]]) -> list[bool]:
    """Nodes that a mark takes away."""
    chars, linked, solid = Counter(), Counter(), Counter()
    for x, text, inside in lines:
        chars[x.node] += len(text)
        linked[x.node] += min(x.linked, len(text))
        solid[x.node] += len(text) * inside
    holds = _summed(Counter(x.article for x, _, _ in lines if x.article), parser.parent)
    chars, linked, solid = (_summed(x, parser.parent) for x in (chars, linked, solid))
    tops = set()
    for k, (mark, container) in parser.marks.items():
        if container:
            away = mark == "readers" or not holds[k] and solid[k] < MOST * solid[0]
        else:
            away = 2 * linked[k] >= chars[k] or not solid[k]
        if away:
            tops.add(k)
    return _below(tops, parser.parent)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tail = html.rfind(">") + 1
    if cut := _TAG.search(html, tail):  # a tag that the page's end cuts off
        html = html[: cut.start()]
    parser = _Events()
    parser.feed(html)
    parser.close()
    found = [(x, text) for x in parser.lines if not x.apart and (text := " ".join("".join(x.parts).split()))]
    if not found:
        return ""
    lines = [(x, text, inside) for (x, text), inside in zip(found, clusters([len(text) for _, text in found], [x.tags for x, _ in found]))]
    if parser.marks:
        away = _left_out(parser, lines)
        lines = [x for x in lines if not away[x[0].node]]
    votes: Counter[int] = Counter()
    for x, text, inside in lines:
        if x.article:
            votes[x.article] += len(text) * (2 if inside else 1)
    if votes:
        best = max(votes, key=lambda k: (votes[k], -k))
        inside_best = _below({best}, parser.parent)
        return "\n".join(text for x, text, _ in lines if inside_best[x.node])
    for x, text, inside in lines:
        if inside and 2 * x.linked < len(text):
            votes[x.node] += len(text)
    sums = _summed(votes, parser.parent)
    at = max((k for k, v in enumerate(sums) if v and v >= MOST * sums[0]), default=0)
    region = _below({at}, parser.parent)
    own = [(x, text, inside and 2 * x.linked < len(text)) for x, text, inside in lines if region[x.node]]
    chosen = [k for k, (x, _, inside) in enumerate(own) if inside or x.heading]
    if not chosen:
        return "\n".join(text for _, text, _ in own)
    if at in parser.pages:  # a flat page: nothing but the clusters tells the article from what is around it
        own = own[chosen[0] : chosen[-1] + 1]
    return "\n".join(text for x, text, _ in own if 2 * x.linked < len(text) or x.heading)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html", 1 << 20):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. No exchange."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(lean(_extract), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
