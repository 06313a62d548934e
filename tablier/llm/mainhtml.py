"""Operator 12: main text of web pages by tag-path ratios.

A page is read in one forward pass (``blocks_of``): a tokenizer whose work is
linear for any markup, broken or not, and a stack of open elements with the
implied end tags of HTML. Every run of text between block boundaries is a
block; its tag path is the root-to-leaf chain of block elements.

Per path, text length and punctuation outside links are summed and divided by
the number of blocks (the tag-path ratios). Both are smoothed along the page by
a Gaussian window, averaged per path again and fused as length * (1 +
punctuation). Paths at or above ``THRESHOLD`` standard deviations of the fused
ratio are content paths. Their blocks are the content nodes; they also fix the
scope: the article, main or articleBody element that holds most of them, else
the deepest container with ``SHARE`` of their text. Within the scope a block of
another path (heading, list item, caption) is kept unless its path is mostly
links; so short articles and short blocks are not lost. With a semantic element
nothing outside is kept but the page's heading.

Zones that are no article by their own statement are left out before the ratios
are taken: elements, roles and class or id words listed below (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments), hidden elements,
scripts, styles and head. A zone named by class, or a form, that holds the
page's article, main or h1 is a wrapper and is not left out.

White space (as ``str.split``) within a block becomes one space; ``br`` counts
as white space, table cells and list items are blocks. Null and empty html, and
pages without text, give an empty text. Unclosed tags, comments and quotes end
as browsers end them. Repeated rows stay; rows with a null page_id or url keep
it. Extra columns are not read. A page is held whole by one task.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content paths have a fused ratio of at least so many standard deviations.
THRESHOLD = 0.5
#: Share of the content text that a container must hold to become the scope.
SHARE = 0.8
#: Share of link text from which an unselected path in the scope is a link list.
LINKS = 0.5
#: Gaussian window over neighbouring blocks.
WINDOW = np.exp(-2.0 * np.arange(-2, 3, dtype=float) ** 2)

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
    tfoot th thead tr ul""".split()
)
ENDS_P = BLOCK - frozenset("body caption colgroup head html legend optgroup option select tbody td tfoot th thead tr li dd dt".split()) | {"li", "dd", "dt"}
BARRIER = frozenset("table td th caption object template html".split())
HEAD_ONLY = frozenset("base link meta title script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("html body div section center main article table tbody tr td form fieldset".split())
# What is no article by its element, role or a word of its class or id.
NOISE_TAGS = frozenset(
    """head nav footer aside form dialog menu search button select textarea label fieldset legend datalist output template svg canvas object audio video
    map progress meter""".split()
)
NOISE_ROLES = frozenset(
    """navigation banner contentinfo complementary search dialog alert alertdialog status menu menubar toolbar tablist form tooltip""".split()
)
NOISE_WORDS = frozenset(
    """ad ads adbox adslot adunit adsense advert adverts advertisement advertisements advertising banner banners promo promos promotion promotions
    sponsor sponsors sponsored sponsorship outbrain taboola cookie cookies consent gdpr notice notices notification notifications popup popups modal
    overlay lightbox newsletter subscribe subscription signup signin login paywall nav navbar navi navigation menu menus menubar breadcrumb breadcrumbs
    crumbs pagination pager paging sidebar sidebars sidenav rail footer foot footnav masthead topbar topnav toolbar related recommended
    recommendations share sharing sharebar social widget widgets skip searchbox searchform search copyright toc""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist commentary disqus replies reply respond discussion".split())
HEADER_WORDS = frozenset("header head siteheader".split())
#: Words that turn a class into a statement about the layout (``has-sidebar``).
LAYOUT_WORDS = frozenset("has no not with without open enabled disabled closed layout".split())
_ARTICLE_WORDS = frozenset("article post entry story content body text".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(>?)")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|style|hidden|href|aria-hidden)\b(?:\s*+=\s*+(?>\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCT = re.compile("[.,;:!?…、。，．：；！？،؛؟۔।]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Block:
    """A run of text with its element and tag path; its pieces are (text, zone, is a link)."""

    pieces: list[tuple[str, int, bool]]
    element: int
    path: int
    tag: str
    text: str = ""
    linked: int = 0

    def without(self, noise: list[bool]) -> "Block":
        """The block with the text of its pieces outside the zones left out."""
        kept = [p for p in self.pieces if not noise[p[1]]]
        self.text = " ".join("".join(text for text, _, _ in kept).split())
        self.linked = min(len(self.text), sum(len(text) for text, _, linked in kept if linked))
        return self


@dataclass
class Page:
    """What the forward pass leaves: blocks in page order and the trees of elements and zones."""

    blocks: list[Block] = field(default_factory=list)
    #: parent, tag, zone and "states to be the article" of each block element; element 0 is the page
    parents: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: ["html"])
    zones: list[int] = field(default_factory=lambda: [0])
    article: list[bool] = field(default_factory=lambda: [False])
    #: parent, left out, may be a wrapper and holds the article of each zone; zone 0 is the page
    zone_parent: list[int] = field(default_factory=lambda: [0])
    zone_noise: list[bool] = field(default_factory=lambda: [False])
    zone_soft: list[bool] = field(default_factory=lambda: [False])
    zone_holds: list[bool] = field(default_factory=lambda: [True])

    def noise(self) -> list[bool]:
        out = []
        for z, parent in enumerate(self.zone_parent):
            own = self.zone_noise[z] and not (self.zone_soft[z] and self.zone_holds[z])
            out.append(own or (z > 0 and out[parent]))
        return out


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw.strip(" /\t\r\n\f"):
        for m in _ATTR.finditer(raw):
            out.setdefault(m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return out


def _words(value: str) -> list[set[str]]:
    return [{w.lower() for w in _WORD.findall(part)} | {part.lower()} for part in value.split()]


def _zone_kind(tag: str, at: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """(left out, may be a wrapper) of an element."""
    if tag in ("html", "body", "main"):
        return False, False
    if "hidden" in at or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return True, False
    if tag in NOISE_TAGS:
        return True, tag == "form"
    if tag == "header" and not in_article:
        return True, False
    if set(at.get("role", "").lower().split()) & NOISE_ROLES:
        return True, False
    soft = False
    for words in _words(f"{at.get('class', '')} {at.get('id', '')}") + ([{*tag.split("-")}] if "-" in tag else []):
        if words & LAYOUT_WORDS:
            continue
        if words & COMMENT_WORDS:
            return True, False
        if words & NOISE_WORDS or (words & HEADER_WORDS and not in_article and not words & _ARTICLE_WORDS):
            soft = True
    return soft, soft


class _Reader:
    """The stack of open elements; every step is amortised constant time."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[tuple[str, int, int, int, bool]] = []  # tag, element, path, zone, in an article
        self.places: dict[str, list[int]] = defaultdict(list)
        self.barriers: list[int] = []
        self.blocks_at: list[int] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.pieces: list[tuple[str, int, bool]] = []
        self.in_link = False

    def top(self) -> tuple[str, int, int, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, 0, 0, False)

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append((entities.unescape(raw) if "&" in raw else raw, self.top()[3], self.in_link))

    def boundary(self) -> None:
        """Close the run of text; called before the element around it changes."""
        if self.pieces:
            tag, element, path, _, _ = self.stack[self.blocks_at[-1]] if self.blocks_at else ("", 0, 0, 0, False)
            self.page.blocks.append(Block(self.pieces, element, path, tag))
            self.pieces = []

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            tag = self.stack[-1][0]
            if tag in BLOCK:
                self.boundary()
                self.blocks_at.pop()
            if tag in BARRIER:
                self.barriers.pop()
            self.places[tag].pop()
            self.stack.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] if self.places[t] else -1) for t in tags)

    def start(self, tag: str, raw: str) -> None:
        page = self.page
        if tag in ("html", "body") and self.places[tag]:
            return
        if self.places["head"] and tag not in HEAD_ONLY:
            self.pop_to(self.places["head"][-1])
        barrier = self.barriers[-1] if self.barriers else -1
        if tag in ENDS_P and self.last("p") > barrier:
            self.pop_to(self.last("p"))
        if tag in HEADINGS and self.top()[0] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag == "li" and self.last("li") > max(barrier, self.last("ul", "ol", "menu", "dir")):
            self.pop_to(self.last("li"))
        elif tag in ("dd", "dt") and self.last("dd", "dt") > max(barrier, self.last("dl")):
            self.pop_to(self.last("dd", "dt"))
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            table = self.last("table")
            inner = self.last("td", "th")
            if inner > table and tag in ("td", "th") and inner > self.last("tr"):
                self.pop_to(inner)
            elif tag not in ("td", "th"):
                row = [i for t in (("tr",) if tag == "tr" else ("tbody", "thead", "tfoot", "tr")) if (i := self.last(t)) > table]
                if row:
                    self.pop_to(min(row))
        elif tag in ("option", "optgroup") and self.top()[0] == "option":
            self.pop_to(len(self.stack) - 1)
        if tag == "a":
            self.in_link = False
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            elif tag == "hr":
                self.boundary()
            return
        at = _attributes(raw)
        if tag == "a":
            self.in_link = "href" in at
        _, element, path, zone, in_article = self.top()
        noise, soft = _zone_kind(tag, at, in_article)
        block = tag in BLOCK
        if block:
            self.boundary()
        if noise:
            page.zone_parent.append(zone)
            page.zone_noise.append(True)
            page.zone_soft.append(soft)
            page.zone_holds.append(False)
            zone = len(page.zone_parent) - 1
        is_article = not noise and (tag in ("article", "main") or at.get("role", "").lower() in ("main", "article") or "articlebody" in at.get("itemprop", "").lower())
        if is_article or (tag == "h1" and not noise):
            z = zone
            while not page.zone_holds[z]:
                page.zone_holds[z] = True
                z = page.zone_parent[z]
        if block:
            label = tag + "".join(sorted("." + w for w in at.get("class", "").lower().split()))
            path = self.paths.setdefault((path, label), len(self.paths) + 1)
            page.parents.append(element)
            page.tags.append(tag)
            page.zones.append(zone)
            page.article.append(is_article)
            element = len(page.parents) - 1
            self.blocks_at.append(len(self.stack))
        if tag in BARRIER:
            self.barriers.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, element, path, zone, in_article or is_article))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag == "br":
            self.text(" ")
        elif tag == "p" and not self.places["p"]:
            self.boundary()
        elif self.places[tag]:
            index = self.places[tag][-1]
            if tag in BLOCK or tag in BARRIER:
                barrier = self.barriers[-1] if self.barriers else -1
                if tag in BARRIER or index > barrier:
                    self.pop_to(index)
            elif index > (self.blocks_at[-1] if self.blocks_at else -1):
                self.pop_to(index)


def blocks_of(source: str) -> Page:
    """One forward pass over the markup."""
    reader, at, end = _Reader(), 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            reader.text(source[at:])
            break
        reader.text(source[at:lt])
        nxt = source[lt + 1 : lt + 2]
        if nxt == "!" and source.startswith("--", lt + 2):
            close = lt + 4 if source.startswith((">", "->"), lt + 4) else source.find("-->", lt + 4)
            at = end if close < 0 else source.find(">", close) + 1
        elif nxt in ("!", "?") or (nxt == "/" and not source[lt + 2 : lt + 3].isascii()) or (nxt == "/" and not source[lt + 2 : lt + 3].isalpha()):
            close = source.find(">", lt)
            at = end if close < 0 else close + 1
        elif nxt == "/" or (nxt.isascii() and nxt.isalpha()):
            m = _TAG.match(source, lt)
            if not m.group(4):
                break  # the page ends within a tag
            at, tag = m.end(), m.group(2).lower()
            if m.group(1):
                reader.end(tag)
            elif tag in RAW:
                if tag not in HEAD_ONLY and reader.places["head"]:
                    reader.pop_to(reader.places["head"][-1])
                close = _RAW_END[tag].search(source, at)
                if not close:
                    break
                stop = source.find(">", close.end())
                at = end if stop < 0 else stop + 1
            else:
                reader.start(tag, m.group(3))
        else:
            reader.text("<")
            at = lt + 1
    reader.pop_to(0)
    reader.boundary()
    return reader.page


def path_ratios(blocks: list[Block]) -> dict[int, float]:
    """Fused, smoothed ratio of each tag path."""
    paths = np.array([b.path for b in blocks])
    length = np.array([len(b.text) - b.linked for b in blocks], float)
    marks = np.array([len(_PUNCT.findall(b.text)) * (1 - b.linked / len(b.text)) for b in blocks])
    ids, which, counts = np.unique(paths, return_inverse=True, return_counts=True)
    fused = np.ones(len(ids))
    near = np.convolve(np.ones(len(blocks)), WINDOW, "full")[2:-2]
    for i, value in enumerate((length, marks)):
        ratio = (np.bincount(which, value) / counts)[which]
        smooth = np.convolve(ratio, WINDOW, "full")[2:-2] / near
        per_path = np.bincount(which, smooth) / counts
        fused *= per_path if i == 0 else 1 + per_path
    return dict(zip(ids.tolist(), fused.tolist()))


def _mass(page: Page, blocks: list[Block], weight: list[float]) -> list[float]:
    """Summed weight of the blocks under each element."""
    total = [0.0] * len(page.parents)
    for b, w in zip(blocks, weight):
        total[b.element] += w
    for e in range(len(total) - 1, 0, -1):
        total[page.parents[e]] += total[e]
    return total


def _scope(page: Page, mass: list[float], noise: list[bool]) -> tuple[int, bool]:
    """The element that holds the article, and whether it states so itself."""
    stated = [e for e in range(1, len(mass)) if page.article[e] and not noise[page.zones[e]]]
    if stated:
        best = max(stated, key=lambda e: (mass[e], -e))
        # the innermost stated element that still holds most of it
        for e in stated:
            if e > best and mass[e] >= SHARE * mass[best] and mass[best] > 0:
                best = e
        return best, True
    children: dict[int, list[int]] = defaultdict(list)
    for e in range(1, len(mass)):
        children[page.parents[e]].append(e)
    here = 0
    while True:
        heavy = [c for c in children[here] if mass[c] >= SHARE * mass[0] and page.tags[c] in CONTAINER]
        if not heavy or not mass[0]:
            return here, False
        here = heavy[0]


def main_text(source: str | None) -> str:
    """The article of a page, one line a block."""
    page = blocks_of(source or "")
    noise = page.noise()
    blocks = [b for b in (x.without(noise) for x in page.blocks) if b.text]
    if not blocks:
        return ""
    ratios = path_ratios(blocks)
    values = np.array([ratios[b.path] for b in blocks])
    cut = THRESHOLD * values.std()
    chosen = [ratios[b.path] >= cut and ratios[b.path] > 0 for b in blocks]
    mass = _mass(page, blocks, [float(len(b.text) - b.linked) if c else 0.0 for b, c in zip(blocks, chosen)])
    scope, stated = _scope(page, mass, noise)
    inside = [False] * len(page.parents)
    for e in range(len(inside)):
        inside[e] = e == scope or (e > 0 and inside[page.parents[e]])
    links: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in blocks:
        links[b.path][0] += b.linked
        links[b.path][1] += len(b.text)
    kept = [
        (c or links[b.path][0] < LINKS * links[b.path][1]) if inside[b.element] else (c and not stated) for b, c in zip(blocks, chosen)
    ]
    heads = [i for i, b in enumerate(blocks) if b.tag == "h1"]
    if len(heads) == 1 and any(kept[heads[0] :]):
        kept[heads[0]] = True  # the page's one heading may stand before its article
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [main_text(h) for h in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(
        _extract, "page_id long, url string, text string, n_chars long"
    )
