"""Operator 4: main text of a web page from streaming parser events and text-to-tag ratios.

The standard library's HTML parser sends events; blocks (the lines of the page) end at block-level tags. Each line has
the ratio of its text outside links to its tags; ratios are smoothed by a Gaussian and clustered against a threshold
into content regions, and only regions select: a page without one has no text. Structure weighs in on both sides. Lines
inside boilerplate elements (by tag, role, or class and id words) have a ratio of zero and are never text. A region
inside an article or main element grows over the lines next to it in the same element, up to one that is mostly links,
so short paragraphs and headings beside long ones stay. Elsewhere a region takes the heading right above it and what
lies between two regions of the same element, and lines that are mostly links are left out.

Edge cases: null and empty html give an empty text; broken and unclosed tags are closed by what follows; character
references are decoded, also without a semicolon; a ratio equal to the threshold (a tie) selects; very long pages are
read whole; repeated rows give the same text; an empty table gives an empty result; extra columns, also with clashing
names, are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button datalist map noframes".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog header search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of a class or id that mark what isn't the article.
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar widget widgets skip hidden".split())
#: Elements that hold blocks which belong together.
HOMES = frozenset("body article main section div center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_WORDS = frozenset("article post entry content story main".split())
CLOSES_P = BLOCK - frozenset(["html", "body", "head", "option", "optgroup"])


@dataclass(frozen=True)
class HtmlParams:
    sigma: float = 1.5  # of the Gaussian, in lines
    threshold: float = 0.5  # of the mean smoothed ratio
    max_link_share: float = 0.6


class _Line:
    __slots__ = ("parts", "tags", "linked", "boiler", "inside", "home", "heading")

    def __init__(self, boiler: bool, inside: tuple[int, ...], home: int, heading: bool):
        self.parts, self.tags, self.linked, self.boiler, self.inside, self.home, self.heading = [], 1, 0, boiler, inside, home, heading


def _words(attrs) -> tuple[set[str], str]:
    words: set[str] = set()
    role = ""
    for k, v in attrs:
        if k in ("class", "id") and v:
            words.update(w.lower() for w in re.findall(r"[A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v)))
        elif k == "role" and v:
            role = v.strip().lower()
        elif k == "hidden" or k == "aria-hidden" and v == "true":
            words.add("hidden")
        elif k == "style" and v and re.search(r"display\s*:\s*none", v, re.I):
            words.add("hidden")
    return words, role


class Events(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, silent, boilerplate, article
        self.silent = self.boiler = self.links = self.headings = self.elements = 0
        self.inside: tuple[int, ...] = ()  # numbers of the open article and main elements
        self.homes = [0]  # numbers of the open elements that hold blocks
        self.line: _Line | None = None

    def _push(self, tag, attrs):
        words, role = _words(attrs)
        inside = tag in ("article", "main") or role in ("main", "article")
        boiler = tag in BOILER_TAGS and not (tag == "header" and self.inside) or role in BOILER_ROLES or tag not in ("html", "body", "article", "main") and bool(words & BOILER_WORDS) and not (words & ARTICLE_WORDS and not words & {"ad", "ads", "comment", "comments", "sidebar", "related", "hidden"})
        if inside and self.inside and tag == "article" and words & {"comment", "comments", "reply"}:
            boiler = True
        silent = tag in SILENT
        self.stack.append((tag, silent, boiler, inside))
        self.silent += silent
        self.boiler += boiler
        self.elements += 1
        if inside:
            self.inside += (self.elements,)
        if tag in HOMES:
            self.homes.append(self.elements)
        self.links += tag == "a"
        self.headings += tag in HEADINGS

    def _pop(self):
        tag, silent, boiler, inside = self.stack.pop()
        self.silent -= silent
        self.boiler -= boiler
        if inside:
            self.inside = self.inside[:-1]
        if tag in HOMES:
            self.homes.pop()
        self.links -= tag == "a"
        self.headings -= tag in HEADINGS

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.line = None
            for i in range(len(self.stack) - 1, -1, -1):  # an open paragraph or item ends at the next block
                t = self.stack[i][0]
                if t == "p" or t == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    while len(self.stack) > i:
                        self._pop()
                    break
                if t in BLOCK:
                    break
        elif self.line is not None:
            self.line.tags += 1
        if tag == "br" and self.line is not None:
            self.line.parts.append(" ")
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.line = None
        elif self.line is not None:
            self.line.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                break
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                break  # an inline end tag doesn't close blocks

    def handle_data(self, data):
        if self.silent:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = _Line(self.boiler > 0, self.inside, self.homes[-1], self.headings > 0)
            self.lines.append(self.line)
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data.strip())


def _regions(ratio: list[float], p: HtmlParams) -> list[bool]:
    """Lines whose smoothed ratio reaches the threshold."""
    if not ratio:
        return []
    reach = max(1, math.ceil(3 * p.sigma))
    kernel = [math.exp(-(k * k) / (2 * p.sigma * p.sigma)) for k in range(-reach, reach + 1)]
    n, smooth = len(ratio), []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        smooth.append(sum(a * b for a, b in zip(w, ratio[lo:hi])) / sum(w))
    cut = p.threshold * sum(smooth) / n
    return [x >= cut and x > 0 for x in smooth]


def extract(html: str | None, p: HtmlParams = HtmlParams()) -> str:
    """Main text of one page: its blocks joined by newlines."""
    if not html:
        return ""
    e = Events()
    e.feed(html)
    e.close()
    lines = []
    for x in e.lines:
        text = " ".join("".join(x.parts).split())
        if text:
            lines.append((text, x))
    ratio = [0.0 if x.boiler else max(0, len(t) - x.linked) / x.tags for t, x in lines]
    content = _regions(ratio, p)
    few_links = [not x.boiler and x.linked <= p.max_link_share * len(t) for t, x in lines]
    own = {x.inside[-1] for c, f, (_, x) in zip(content, few_links, lines) if c and f and x.inside}
    keep = [c and (f or not x.boiler and bool(x.inside) and x.inside[-1] in own) for c, f, (_, x) in zip(content, few_links, lines)]
    picked = [i for i, k in enumerate(keep) if k]
    last = None
    for i in picked:
        here = lines[i][1]
        if here.inside:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(lines) and here.inside[-1] in lines[j][1].inside and (lines[j][1].boiler or few_links[j] and not keep[j]):
                    keep[j] = not lines[j][1].boiler
                    j += step
            continue
        if i and lines[i - 1][1].heading and lines[i - 1][1].home == here.home:
            keep[i - 1] = keep[i - 1] or few_links[i - 1]
        for j in range(last + 1, i) if last is not None else ():
            between = lines[j][1]
            keep[j] = keep[j] or few_links[j] and not between.inside and between.home == here.home == lines[last][1].home
        last = i
    return "\n".join(t for (t, _), k in zip(lines, keep) if k)


def main_text(pages: DataFrame, p: HtmlParams | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page. No shuffle; a page is one row of an Arrow batch."""
    p = p or HtmlParams()

    def run(batches):
        for b in batches:
            for part in slices(b, 2, 1000, 16 << 20):
                text = [extract(h, p) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
