"""Main text of web pages by composite text density.

A page is parsed into nodes in page order. What its tag, role or name marks as a menu, header, footer, sidebar,
notice, advert, form, script, style or comments is pruned first. Of every node that is left, with C characters, LC of
them in links, T tags and LT link tags, and of the body b,

    density = C / T * log(C / LC * T / LT) / log(max(e, ln(C / (C - LC) * LC + LC_b / C_b * C + e)))

where zero divisors count as one; without links that is C / T * log(C * T), and nothing but links gives 0. The text
that stands in a block beside other blocks counts as a child of its own, with its inline tags. A block's sum is that
of its children's densities, and the block with the largest sum (the first of equal ones) is the core of the article.

Where the core lies in an article element or in main, all of the outermost such article, or of that main, is the
text. Elsewhere the threshold is the least density on the path from the core to the body: beside the core, blocks
that reach it are text too, and so are headings beside such blocks. Each page is worked on by itself in the task that
reads it; there is no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What opening a tag closes: (tags it closes, tags that stop the search).
_SCOPE = frozenset("table td th caption html template button object".split())
_OTHER_SCOPE, _BLOCK_OR_SCOPE = {t: _SCOPE - {t} for t in _SCOPE}, _BLOCK | _SCOPE
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, {"body"})}
_HEAD_ONLY = frozenset("base link meta title style script noscript template".split())

_NOISE_TAGS = frozenset("script style noscript template head title nav footer aside form dialog menu button select textarea input label iframe object embed svg canvas audio video map datalist search".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog form status tooltip".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsors sponsored promo promos promotion outbrain taboola "
    "comment comments commentlist disqus respond replies "
    "sidebar sidebars sidenav widget widgets toolbar "
    "menu menus nav navbar navigation topnav breadcrumb breadcrumbs pager pagination skiplink "
    "header masthead topbar siteheader footer foot sitefooter colophon copyright "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login paywall disclaimer "
    "related recommended recommendations share sharing social".split()
)
_ARTICLE_NAMES = frozenset("comment comments ad ads advert advertisement sponsored promo related teaser".split())
_SWITCHES = frozenset("has no with without is not hide show".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


def _names(attrs: dict) -> set[str]:
    found = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [p.lower() for p in _CAMEL.split(name) if p]
        if parts and parts[0] not in _SWITCHES:
            found.update(parts)
    return found


class Page(HTMLParser):
    """Nodes in page order as parallel lists, and the page's text as pieces between block edges (None)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.noise, self.first, self.last = ["#page"], [-1], [""], [0], [0]
        self.pieces: list[str | None] = []
        self.owner: list[int] = []
        self.open, self.count = [0], Counter()
        self.linked: list[bool] = []
        self.links = 0

    def _put(self, text: str | None) -> None:
        self.pieces.append(text)
        self.owner.append(self.open[-1])
        self.linked.append(self.links > 0)

    def _pop(self) -> None:
        node = self.open.pop()
        self.count[self.tag[node]] -= 1
        self.links -= self.tag[node] == "a"
        if self.tag[node] in _BLOCK:
            self._put(None)
        self.last[node] = len(self.pieces)

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Closes up to the innermost open element of ``tags``, unless one of ``stop`` stands before it."""
        if not any(self.count[t] for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in tags:
                while len(self.open) > at:
                    self._pop()
                return
            if tag in stop:
                return

    def _kind(self, tag: str, attrs: dict) -> str:
        """Why an element is noise: "tag", "name" (void where it holds the article), or empty."""
        if tag in ("html", "body", "main"):
            return ""
        within = self.count["article"] or self.count["main"]
        if tag == "article":
            return "tag" if self.count["article"] else "name" if _names(attrs) & _ARTICLE_NAMES else ""
        if tag in ("form", "header"):
            return "" if tag == "header" and within else "name"
        if tag in _NOISE_TAGS:
            return "tag"
        if (attrs.get("role") or "").strip().lower() in _NOISE_ROLES:
            return "name"
        names = _names(attrs)
        if names & _NOISE_NAMES and not (names & _NOISE_NAMES <= {"header"} and within) and tag not in _HEADING:
            return "name"
        return ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and self.count[tag]:
            return
        if tag not in _HEAD_ONLY and self.tag[self.open[-1]] == "head" and tag != "head":
            self._pop()
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in _BLOCK:
            self._close({"p"}, _SCOPE)
        if tag in _BLOCK:
            self._put(None)
        elif tag in ("br", "td", "th"):
            self._put(" ")
        node, above = len(self.tag), self.open[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.noise.append("tag" if self.noise[above] == "tag" else self._kind(tag, dict(attrs)))
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] += 1
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.count["p"]:
            self._put(None)
        elif tag in _BLOCK or tag in _SCOPE:
            self._close({tag}, _OTHER_SCOPE.get(tag, _SCOPE))
        else:
            self._close({tag}, _BLOCK_OR_SCOPE)

    def handle_data(self, data: str) -> None:
        if self.noise[self.open[-1]] != "tag":
            self._put(data)

    def finish(self) -> Page:
        self.close()
        while len(self.open) > 1:
            self._pop()
        self.last[0] = len(self.pieces)
        return self


def _prune(page: Page) -> list[bool]:
    """Which nodes are noise, with all below them. A name does not make noise of what holds main or an article."""
    n = len(page.tag)
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        if page.tag[k] in ("main", "article") and not page.noise[k]:
            holds[k] = True
        if holds[k] and page.noise[k] != "tag":
            holds[page.parent[k]] = True
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[page.parent[k]] or page.noise[k] == "tag" or (page.noise[k] == "name" and not holds[k])
    return gone


def density(c: int, lc: int, t: int, lt: int, ratio: float) -> float:
    """Composite density of c characters, lc in links, in t tags, lt of links; ``ratio`` is the body's LC / C."""
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = max(math.e, math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
    return c / t * math.log(c / max(lc, 1) * t / lt) / math.log(base)


class Densities:
    """Characters, tags, densities and sums of a page's nodes that are not noise."""

    def __init__(self, page: Page, gone: list[bool]) -> None:
        n = len(page.tag)
        self.page, self.gone = page, gone
        block = [t in _BLOCK or k == 0 for k, t in enumerate(page.tag)]
        nearest = list(range(n))
        for k in range(1, n):
            nearest[k] = k if block[k] else nearest[page.parent[k]]
        c, lc, t, lt = [0] * n, [0] * n, [1] * n, [int(x == "a") for x in page.tag]
        own_c, own_lc, own_t, own_lt = [0] * n, [0] * n, [1] * n, [0] * n
        for text, at, linked in zip(page.pieces, page.owner, page.linked):
            if text and not gone[at]:
                size = len("".join(text.split()))
                c[at] += size
                lc[at] += size * linked
                own_c[nearest[at]] += size
                own_lc[nearest[at]] += size * linked
        for k in range(n - 1, 0, -1):
            if gone[k]:
                continue
            up = page.parent[k]
            for total in (c, lc, t, lt):
                total[up] += total[k]
            if not block[k]:
                own_t[nearest[k]] += 1
                own_lt[nearest[k]] += page.tag[k] == "a"
        self.body = next((k for k in range(n) if page.tag[k] == "body"), 0)
        ratio = lc[self.body] / max(c[self.body], 1)
        self.chars, self.block = c, block
        self.density = [0.0 if gone[k] else density(c[k], lc[k], t[k], lt[k], ratio) for k in range(n)]
        self.sum = [density(own_c[k], own_lc[k], own_t[k], own_lt[k], ratio) if block[k] and not gone[k] else 0.0 for k in range(n)]
        for k in range(n - 1, 0, -1):
            if block[k] and not gone[k]:
                self.sum[nearest[page.parent[k]]] += self.density[k]

    def path(self, node: int) -> list[int]:
        found = [node]
        while found[-1] not in (self.body, 0):
            found.append(self.page.parent[found[-1]])
        return found


def content(page: Page) -> tuple[list[int], list[bool]]:
    """The topmost nodes of the main text, in page order, and which nodes are noise."""
    gone = _prune(page)
    d = Densities(page, gone)
    n = len(page.tag)
    blocks = [k for k in range(n) if d.block[k] and not gone[k] and d.chars[k]]
    if not blocks:
        return [], gone
    core = max(blocks, key=lambda k: (d.sum[k], -k))
    path = d.path(core)
    for tag in ("article", "main"):
        around = [k for k in path if page.tag[k] == tag]
        if around:
            return [around[-1]], gone
    least = min(d.density[k] for k in path)
    taken = [False] * n
    taken[core] = True
    walked = set(path)
    for k in range(1, n):
        above = page.parent[k]
        if d.block[k] and not gone[k] and d.chars[k] and not taken[k]:
            if taken[above] or (k not in walked and (above in walked or not d.block[above]) and d.density[k] >= least and d.density[k] > 0):
                taken[k] = True
        elif taken[above] and not gone[k]:
            taken[k] = True
    for k in range(1, n):
        if page.tag[k] in _HEADING and not gone[k] and page.parent[k] in walked and (page.tag[k] == "h1" or page.parent[k] not in (0, d.body)):
            taken[k] = True
    return [k for k in range(n) if taken[k] and (k == 0 or not taken[page.parent[k]])], gone


def blocks_of(page: Page, nodes: list[int], gone: list[bool]) -> list[str]:
    """The blocks' texts of some nodes, in page order, white space made one space."""
    found, now = [], []
    for node in nodes:
        for k in range(page.first[node], page.last[node]):
            text = page.pieces[k]
            if text is None:
                found.append("".join(now))
                now = []
            elif not gone[page.owner[k]]:
                now.append(text)
        found.append("".join(now))
        now = []
    return [t for t in (" ".join(x.split()) for x in found) if t]


def _whole(html: str) -> str:
    """Without a comment or a tag that the page's end cuts off."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0:
        html = html[:at]
    at = html.rfind("<")
    return html[:at] if at >= 0 and ">" not in html[at:] and re.match(r"</?[A-Za-z]", html[at:]) else html


def extract(html: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not html:
        return ""
    page = Page()
    page.feed(_whole(html))
    nodes, gone = content(page.finish())
    return "\n\n".join(blocks_of(page, nodes, gone))


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": pdf.html.map(extract, na_action=None)})


def main_text(pages: DataFrame, batch_rows: int = 256) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row, by its whole html.

    Null and empty html, and pages of nothing but noise, give an empty text. Unclosed and unknown tags, deep nesting
    and cut-off pages are read as far as they go. Repeated rows and rows with a null page_id or url have rows of their
    own; an empty table gives none; further columns are ignored. Rows are written to the shared folder, with
    ``batch_rows`` pages at a time in a worker, and read back."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    found = stage(rows.mapInPandas(_extracted, "page_id string, url string, text string"), "main-text", batch_rows)
    return found.select(F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
