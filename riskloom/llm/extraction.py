"""Operator 12: the main text of web pages by text-to-tag ratios.

1. The standard library's parser streams its events; tags that begin or end a block cut the page
   into lines. Open elements are kept as browsers do it: a block ends an open paragraph, an item
   ends the item before it, an end tag closes what is open inside its element. What is never
   article is left out with all it holds: scripts, styles, forms, navigation, footers, asides,
   and elements whose role or class names say so (menus, notices, adverts, comments...).
2. The text-to-tag ratio of a line: characters that are not in links, by the tags in it and
   before it.
3. Ratios are smoothed by a Gaussian over the neighbouring lines.
4. Two clusters of the smoothed ratios (2-means of their logarithms) give the threshold; lines
   above it are content.
5. The region: the article element with the most content, if the page has one; else the main
   element; else the innermost element that holds four fifths of the content. Of a region, short
   lines stay too; parts of it without any content line and lines that are links go, unless the
   page itself names the region.

White space of any kind inside a line becomes one space; lines are joined by two line feeds in page
order. Nothing is capped. NULL and empty pages, and pages without content, give an empty text.
Markup may be cut off or nested to any depth: the work is linear in the page. Rows are read alone,
so ties, repeated rows and other columns change nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Collection, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy, whole

# Fixed values of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote pre figure figcaption caption address summary ul ol dl table".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed footer form frameset head header iframe input label map menu nav noframes noscript object "
    "optgroup option script search select style svg template textarea title video".split()
)
HEAD = frozenset("base link meta noscript script style template title".split())
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
ENDS |= {"td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
WITHIN = {"li": ("ul", "ol", "menu", "dir"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
NOT_TEXT = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs byline captcha comment comments "
    "commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown footer gdpr header login masthead menu menus modal nav navbar "
    "navigation navi newsletter notice notices notification outbrain overlay pager pagination paywall popup popups promo promoted promotion recommended "
    "related replies reply respond responses rail search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe "
    "subscription taboola teaser teasers toolbar topbar widget widgets".split()
)
TEXT = frozenset("article body content entry headline main post story text title".split())
WEAK = frozenset("alert banner header".split())
UNLESS = frozenset("has with without no not is js".split())
NAMED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SMOOTH = np.exp(-0.5 * np.arange(-2, 3) ** 2)


@lru_cache(maxsize=65_536)
def outside(names: str) -> bool:
    """Do class names or an id say that an element is no part of an article?"""
    for name in names.split():
        words = [w.lower() for w in NAMED.findall(name)]
        said = NOT_TEXT.intersection(words)
        if not said or words[0] in UNLESS or words[-1] == "free":
            continue
        if said <= WEAK and TEXT.intersection(words):
            continue  # as in post-header
        return True
    return False


class Lines(HTMLParser):
    """The lines of a page: text, characters in links, tags, element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.up, self.cause = ["html"], [0], [""]  # of each element; cause: why it is left out
        self.stack, self.open = [0], defaultdict(int)
        self.parts, self.linked, self.tags = [], 0, 0
        self.lines: list[tuple[str, int, int, int]] = []

    def page(self, html: str) -> "Lines":
        self.feed(html)
        self.close()
        self._cut()
        return self

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.linked, self.tags, self.stack[-1]))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[self.tag[node]] -= 1
        del self.stack[depth:]

    def _find(self, tags: tuple[str, ...], stops: Collection[str]) -> int:
        """Depth of the innermost open one of tags above all of stops; 0: none."""
        if self.open[tags[0]] <= 0 and self.open[tags[-1]] <= 0:
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in stops:
                return 0
        return 0

    def _cause(self, tag: str, attrs: list) -> str:
        over = self.cause[self.stack[-1]]
        root = tag in ("article", "main")
        if over and not (root and over in ("form", "nav", "header")):
            return over
        if tag in NEVER and not (tag == "header" and (self.open["article"] or self.open["main"])):
            return tag
        if not attrs or tag in ("html", "body", "a"):
            return ""
        held = dict(attrs)
        if "hidden" in held or held.get("aria-hidden") == "true" or (held.get("role") or "").lower() in ROLES:
            return "role"
        if "none" in (held.get("style") or "") and re.search(r"display\s*:\s*none", held["style"]):
            return "role"
        names = f"{held.get('class') or ''} {held.get('id') or ''}"
        return "class" if len(names) > 1 and outside(names) else ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._cut()
            if depth := self._open_paragraph():
                self._pop(depth)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "body" or (self.open["head"] > 0 and tag not in HEAD and tag != "head" and self.tag[self.stack[-1]] == "head"):
            self._pop(1)
        if tag in ENDS and (depth := self._find(*ENDS[tag])):
            self._pop(depth)
        cause = self._cause(tag, attrs)
        self.tag.append(tag)
        self.up.append(self.stack[-1])
        self.cause.append(cause)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # <div/> opens a div

    def _open_paragraph(self) -> int:
        """Depth of an open p with nothing but inline elements inside; 0: none."""
        if self.open["p"] <= 0:
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag == "p":
                return depth
            if tag in BLOCK:
                return 0
        return 0

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._cut()
        self.tags += tag not in VOID
        if self.open[tag] <= 0:
            return
        if self.tag[self.stack[-1]] == tag:
            self._pop(len(self.stack) - 1)
            return
        depth = self._find((tag,), WITHIN.get(tag, ()) if tag in BLOCK else BLOCK)
        if depth:
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        if not self.cause[self.stack[-1]]:
            self.parts.append(data)
            if self.open["a"] > 0:
                self.linked += len("".join(data.split()))

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns are not asked for

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)  # a section of any name ends at the next mark
        return len(self.rawdata) if end < 0 else end + 1


def threshold(ratios: np.ndarray, longest: float) -> float:
    """Between the two clusters of the logarithms of ratios. Where all are alike, all is content
    if it has some text to a tag or a line (longest: its characters) as long as a paragraph."""
    x = np.log1p(ratios)
    low, high = float(x.min()), float(x.max())
    if high - low < np.log(4):  # one cluster
        return 0.0 if high >= np.log1p(8) or longest >= 80 else np.inf
    for _ in range(30):
        cut = (low + high) / 2
        a, b = x[x < cut].mean(), x[x >= cut].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    return min(float(np.expm1((low + high) / 2)), 60.0)


def main_text(html: str) -> str:
    page = Lines().page(html)
    lines = page.lines
    if not lines:
        return ""
    chars = np.array([len("".join(t.split())) for t, *_ in lines], float)
    linked = np.array([n for _, n, *_ in lines], float)
    plain = np.maximum(chars - linked, 0)
    ratio = plain / np.maximum(np.array([n for *_, n, _ in lines]), 1)
    smooth = np.convolve(ratio, SMOOTH, "full")[2:-2] / np.convolve(np.ones(len(ratio)), SMOOTH, "full")[2:-2]
    smooth = np.where(plain > 0, smooth, 0)
    content = smooth >= max(threshold(smooth, plain.max()), 1e-9)
    at = [node for *_, node in lines]

    # What each element holds: content characters and all characters, summed from inside out.
    mass, total = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    np.add.at(mass, at, np.where(content, plain, 0))
    np.add.at(total, at, plain)
    for node in range(len(page.tag) - 1, 0, -1):
        mass[page.up[node]] += mass[node]
        total[page.up[node]] += total[node]

    inside = np.zeros(len(page.tag), bool)
    named = []
    for kind in ("article", "main"):
        under = np.zeros(len(page.tag), bool)
        for node in range(1, len(page.tag)):
            under[node] = under[page.up[node]]
            if page.tag[node] == kind and not page.cause[node] and not under[node] and total[node] > 0:
                under[node] = True
                named.append(node)
        if named and total[named].max() >= mass[0] / 4:
            break
        named = []
    if named:
        inside[[n for n in named if total[n] >= total[named].max() / 2]] = True
        for node in range(1, len(page.tag)):
            inside[node] |= inside[page.up[node]]
        keep = inside[at] & ~_link_lists(page, linked, chars)
    else:
        if not content.any():
            return ""
        held = {}
        for node in range(1, len(page.tag)):
            if page.tag[node] in BLOCK and page.tag[node] not in LEAF - {"td", "table", "tbody", "tr"}:
                held.setdefault(_holder(page, page.up[node]), []).append(node)
        top = 0
        while (best := max(held.get(top, ()), key=lambda n: mass[n], default=None)) is not None and mass[best] >= 0.8 * mass[0]:
            top = best
        inside[top] = True
        for node in range(1, len(page.tag)):
            box = page.tag[node] in BLOCK and page.tag[node] not in LEAF
            inside[node] |= inside[page.up[node]] and not (box and mass[node] == 0)
        keep = inside[at] & (linked <= 0.6 * chars)
        first = int(np.argmax(keep)) if keep.any() else 0
        while first and page.tag[at[first - 1]] in ("h1", "h2") and not linked[first - 1]:  # the heading above the region
            first -= 1
            keep[first] = True
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(keep))


def _holder(page: Lines, node: int) -> int:
    """The innermost element at or above node that can be a region."""
    while node and not (page.tag[node] in BLOCK and page.tag[node] not in LEAF - {"td", "table", "tbody", "tr"}):
        node = page.up[node]
    return node


def _link_lists(page: Lines, linked: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Items of lists of three or more in which all is links."""
    owner: dict[int, list[int]] = {}
    for i, (*_, node) in enumerate(page.lines):
        while node and page.tag[node] not in ("ul", "ol"):
            node = page.up[node]
        if node:
            owner.setdefault(node, []).append(i)
    out = np.zeros(len(chars), bool)
    for own in owner.values():
        if len(own) >= 3 and (linked[own] >= 0.9 * chars[own]).all():
            out[own] = True
    return out


@F.arrow_udf(T.StringType())
def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p) if p else "" for p in pages.to_pylist()], pa.string())
    tidy()


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of html as column text; a column of that name is replaced."""
    return pages.withColumn(text, extracted(whole(html)))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
