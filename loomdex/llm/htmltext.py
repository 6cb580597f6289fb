"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from the root down to it. All blocks of a path
share their figures: characters and punctuation marks per block. Both ratios are smoothed over the page with a Gaussian,
fused by their geometric mean, and paths above a share of the spread of the fused values are content. The element that
holds nearly all text of content paths is the article; its blocks are the text, so that a short paragraph, a heading or
a table cell stays with the long paragraphs beside it. What elements, roles and names say outright (menus, headers,
footers, sidebars, notices, adverts, forms, comments, hidden parts, scripts, styles) is left out before, and lists that
are nothing but links afterwards.

Inline markup joins without a space, ``br`` counts as white space; character references are decoded; white space inside
a block (Unicode's) becomes one space, blocks are trimmed and joined by one space. Names on the way down are read in one
pass that is linear in the page, however deep, broken or long it is: elements that are never closed end with what holds
them, and an open quote, comment or script at the end of the page is closed there.

Defined results: a null or empty page, or one without an article, gives an empty text; a page without markup is all
text; where names would leave nothing, they are not believed, and where no path stands out all of the article or body is
taken; repeated pages give equal texts; ties play no part; an empty table gives no rows. All columns of the input are
kept but for those that have the name of a new one. Rows are never moved.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of HTML elements, and words that name parts of pages.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noframes noembed iframe xmp template".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: An element and those that it ends when it begins, up to the nearest of the last ones.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",))}
ENDS = {k: (frozenset(closed.split()), frozenset(until)) for k, (closed, until) in ENDS.items()}
NOT_TEXT = frozenset("head nav footer aside form button select option datalist dialog menu svg math canvas object audio video map fieldset".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that say outright what a part is, and weaker ones that hold unless it names an article as well.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social related recommended recommendations pagination pager popup modal".split())
WEAK = frozenset("banner notice notices alert header masthead topbar toolbar widget overlay side rail aside respond replies login search skip tags outbrain taboola".split())
ARTICLE_WORDS = frozenset("article post entry content story body text main".split())
MODIFIERS = frozenset("has with without no".split())
STRONG_STARTS = ("advert", "adsense", "adslot", "cookie", "comment", "newsletter", "breadcrumb", "sponsor", "promo")
#: Elements that can be the article, those whose names are not believed, and marks that count.
HOLDERS = frozenset("html body main article section div td center table tbody tr".split())
TRUSTED = frozenset("html body main".split())
_PUNCTUATION = re.compile("[,.;:!?…、。！，：；？،؛؟।]")

#: A tag: quotes count after an equals sign only; the second form is for pages with a quote that never ends.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?![\s"'])))*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = frozenset("article post entry content story body text main".split())
MODIFIERS = frozenset("has with without no".split())
STRONG_STARTS = ("advert", "adsense", "adslot", "cookie", "comment", "newsletter", "breadcrumb", "sponsor", "promo")
#: Elements that can be the article, those whose names are not believed, and marks that count.
HOLDERS = frozenset("html body main article section div td center table tbody tr".split())
TRUSTED = frozenset("html body main".split())
_PUNCTUATION = re.compile("[,.;:!?…、。！，：；？،؛؟।]")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=$|[\s/"'])""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([^\s"'>\d]+)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}

#: Shares: of the spread of fused values that a path needs, of content that the article holds, of link characters in a list of links.
LEAST_SPREAD, HELD, LINKS = 0.5, 0.9, 0.5
#: Weights of a block and of the next two on either side.
GAUSS = tuple(math.exp(-(d * d) / 2) for d in range(3))


class Block(NamedTuple):
    """A block of text: its text, characters within links, punctuation marks, element, path, and whether it is left out
    by its element (2), by a name (1) or not at all (0)."""

    text: str
    linked: int
    marks: int
    element: int
    path: int
    out: int


class Page(NamedTuple):
    """Blocks in order; tag, parent and path of each element, parents first."""

    blocks: list[Block]
    tags: list[str]
    parents: list[int]


def _judged(tag: str, attributes: str, inside: bool) -> int:
    """2 if an element says that it is no article text, 1 if a name says so, else 0. inside: within an article."""
    if tag in NOT_TEXT or tag == "header" and not inside:
        return 2
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if not found:
        return 0
    hidden = "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true"
    if hidden or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in NOT_TEXT_ROLES:
        return 2
    if tag in TRUSTED:
        return 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & MODIFIERS:
            continue
        if (words & STRONG or any(w.startswith(STRONG_STARTS) for w in words)) and (tag != "article" or words & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo"}):
            return 1
        if words & WEAK and not words & ARTICLE_WORDS and not (inside and "header" in words):
            return 1
    return 0


def parse(html: str) -> Page:
    """Blocks of a page and its block elements, in one pass."""
    tags, parents, path_of, out_of = [""], [-1], [0], [0]
    paths: dict[tuple[int, str], int] = {}
    stack, opened = [0], {"": 1}
    blocks: list[Block] = []
    said: list[str] = []
    linked, link, articles, at, quoted = 0, False, 0, 0, True

    def end_block() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            if text:
                here = stack[-1]
                blocks.append(Block(text, min(linked, len(text)), len(_PUNCTUATION.findall(text)), here, path_of[here], out_of[here]))
            said.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if out_of[stack[-1]] == 2 or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        said.append(text)
        if link:
            linked += len(text.strip())

    def close_to(depth: int) -> None:
        nonlocal articles, link
        for e in stack[depth:]:
            opened[tags[e]] -= 1
            articles -= tags[e] in ("article", "main")
        if any(tags[e] not in INLINE for e in stack[depth:]):
            end_block()
            link = False
        del stack[depth:]

    size = len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        follow = html[lt + 1 : lt + 2]
        if not (follow.isascii() and (follow.isalpha() or follow in ("/", "!", "?"))) or follow == "" or follow == "/" and not html[lt + 2 : lt + 3].isalpha():
            say(html[at : lt + 1])
            at = lt + 1
            continue
        say(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = size if end < 0 else end + 3
            continue
        if follow in "!?":
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) if quoted else None
        if m is None:
            m, quoted = _PLAIN_TAG.match(html, lt), False  # a quote without end: from here on none is believed
        if m is None:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag == "a":
                link = False
            if tag in RAW:
                continue
            if tag == "p" and not opened.get("p"):
                end_block()
            elif opened.get(tag):
                depth = len(stack) - 1
                while tags[stack[depth]] != tag:
                    depth -= 1
                close_to(depth)
            elif tag not in INLINE:
                end_block()
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = size if end is None else end.start()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in INLINE:
            link = link or tag == "a" and "href" in attributes.lower()
            judged = _judged(tag, attributes, articles > 0) if attributes and tag not in VOID else 0
            if not judged:
                continue
        else:
            if tag in CLOSES_P and opened.get("p"):
                depth = len(stack) - 1
                while tags[stack[depth]] != "p":
                    depth -= 1
                close_to(depth)
            if tag in ENDS:
                closed, until = ENDS[tag]
                depth = len(stack) - 1
                least = depth + 1
                if any(opened.get(c) for c in closed):
                    while depth > 0 and tags[stack[depth]] not in until:
                        if tags[stack[depth]] in closed:
                            least = depth
                        depth -= 1
                if least < len(stack):
                    close_to(least)
            end_block()
            if tag in VOID or attributes.rstrip().endswith("/") and tag in ("svg", "math", "path"):
                continue
            judged = _judged(tag, attributes, articles > 0)
        parent = stack[-1]
        if tag in INLINE:
            judged = 2  # an inline part that is left out is dropped from the block around it
        step = tag
        if tag in HOLDERS and attributes:
            named = _CLASS.search(attributes)
            step = f"{tag}.{named[1].lower()}" if named else tag
        key = (path_of[parent], step)
        tags.append(tag), parents.append(parent), out_of.append(max(judged, out_of[parent])), path_of.append(paths.setdefault(key, len(paths) + 1))
        stack.append(len(tags) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        articles += tag in ("article", "main")
    end_block()
    return Page(blocks, tags, parents)


def content_paths(blocks: list[Block]) -> set[int]:
    """Paths whose smoothed and fused ratios stand out."""
    figures: dict[int, list[int]] = {}
    for b in blocks:
        f = figures.setdefault(b.path, [0, 0, 0])
        f[0] += 1
        f[1] += len(b.text) - b.linked
        f[2] += b.marks
    ratios = [(figures[b.path][1] / figures[b.path][0], figures[b.path][2] / figures[b.path][0]) for b in blocks]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = [(GAUSS[abs(d)], values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [math.sqrt(t * p) for t, p in zip(smooth([r[0] for r in ratios]), smooth([r[1] for r in ratios]), strict=True)]
    mean = sum(fused) / len(fused)
    least = LEAST_SPREAD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    total: dict[int, float] = {}
    for b, x in zip(blocks, fused, strict=True):
        total[b.path] = total.get(b.path, 0.0) + x
    # a path's own ratio has to be there too: smoothing alone makes nothing content
    return {p for p, x in total.items() if x > 0 and x / figures[p][0] >= least and figures[p][2] > 0}


def article_of(page: Page, blocks: list[Block], paths: set[int]) -> int:
    """The lowest element that holds nearly all content; an article or main element with most of it ends the search."""
    mass = [0] * len(page.tags)
    for b in blocks:
        if b.path in paths:
            mass[b.element] += len(b.text)
    for e in range(len(page.tags) - 1, 0, -1):
        mass[page.parents[e]] += mass[e]
    best, whole = 0, mass[0]
    for e in range(1, len(page.tags)):  # parents come first
        tag = page.tags[e]
        if page.parents[e] == best and tag in HOLDERS and mass[e] >= (0.6 if tag in ("article", "main") else HELD) * whole > 0 and page.tags[best] != "article" and (page.tags[best] != "main" or tag == "article"):
            best = e
    if best == 0 or page.tags[best] in ("html", "body"):
        named = [e for e in range(1, len(page.tags)) if page.tags[e] in ("article", "main") and mass[e] >= 0.6 * whole > 0]
        best = named[0] if named else best
    return best


def main_text(html: str | None) -> str:
    """The text of a page's article, '' if there is none."""
    page = parse(html or "")
    for believed in (1, 2):
        blocks = [b for b in page.blocks if b.out < believed]
        if blocks:
            break
    else:
        return ""
    paths = content_paths(blocks)
    article = article_of(page, blocks, paths)
    if not paths:
        named = [e for e, t in enumerate(page.tags) if t == "article"] or [e for e, t in enumerate(page.tags) if t == "main"]
        article = named[0] if named else 0
    inside = [False] * len(page.tags)
    for e in range(len(page.tags)):  # parents come first
        inside[e] = e == article or page.parents[e] >= 0 and inside[page.parents[e]]
    links: dict[int, list[int]] = {}
    for b in blocks:
        f = links.setdefault(b.path, [0, 0])
        f[0] += b.linked
        f[1] += len(b.text)
    kept = [b for b in blocks if inside[b.element] and (b.path in paths or links[b.path][0] <= LINKS * links[b.path][1])]
    # the title of an article that has its body in an element of its own
    if kept and page.tags[article] not in ("article", "main", "body", "html", ""):
        first = blocks.index(kept[0])
        while first > 0 and len(blocks[first - 1].text) < 200 and page.tags[blocks[first - 1].element] not in ("h1", "li", "td"):
            first -= 1
        if first > 0 and page.tags[blocks[first - 1].element] == "h1":
            kept.insert(0, blocks[first - 1])
    return " ".join(b.text for b in kept)


def extract(df: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Add the main text of each page and its number of code points."""
    added = [(text, T.StringType(), pa.string()), (n_chars, T.LongType(), pa.int64())]
    df = df.drop(*[n for n, *_ in added if n != html])
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t, _ in added])
    at, own = df.columns.index(html), [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                found = [main_text(x) for x in part.column(at).to_pylist()]
                new = [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), *new], [*(f.name for f in kept), *(n for n, *_ in added)])

    return df.mapInArrow(run, schema)
