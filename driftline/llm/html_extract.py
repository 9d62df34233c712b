"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of text; scripts, styles, form
controls and what is not shown leave none.  A line weighs its characters outside
links, one in an article or main element more, one in a menu, footer, advert or
the like nothing.  Tags that only lay out the page leave lines without text.
Sums over a sliding window of lines rise at a surge point and fall to nothing at
a dive point; the text between is kept where a window is high enough.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import keep_clashing, small_batches

#: Lines per window.
WINDOW = 3
#: Characters in a window that mark a surge on an ordinary page.
SURGE = 86
#: Weight of a character in an article or main element; one elsewhere weighs 1.
ARTICLE_WEIGHT = 16
#: Share of a line's characters inside links above which it weighs nothing.
LINK_SHARE = 0.5

# Element names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
CONTROLS = frozenset("head form button select dialog search fieldset label datalist output progress meter".split())
ASIDES = frozenset("nav footer aside menu".split())
LAYOUT = frozenset("article aside body center div footer header main nav section table tbody td th tr".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset("article div dl ol section table ul".split())
#: Elements within sentences.
PHRASES = frozenset("abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
#: Elements whose end tag may be left out, with the start tags that end them.
IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "head": {"body"}} | dict.fromkeys(("td", "th"), frozenset("td th tr tbody tfoot thead".split()))

#: Groups: a tag without "<" in its attributes (1 to 3), the start of any other tag (4, 5), text (6).
#: A quote opens a value only after "=".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>=\"']*+)((?:[^<>=]|=\s*+\"[^\"<]*+\"|=\s*+'[^'<]*+'|=(?!\s*+[\"']))*+)>|<(/?)([a-zA-Z][^\s/<>=\"']*+)|<[!?][^<>]*>|<[/!?][^<>]*\Z|([^<]+|<)", re.DOTALL)
#: What leads to the next value in quotes, or to the tag's end.
_STEP = re.compile(r"(?:[^<>=]|=(?!\s*+[\"']))*+(?:=\s*+([\"'])|>)")
#: A tag whose quotes do not pair.
_LOOSE = re.compile(r"[^<>]*+>")


#: Words of class and id tokens.  A token names an unwanted element if all of its parts are of the
#: three sets or numbers, and one is of the first two.
_COMMENT_WORDS = frozenset("comment comments respond disqus".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion promotions banner banners nav navs navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars footer cookie cookies cookiebar cookieconsent consent notice notices popup modal newsletter subscribe signup login share sharing social related recommend recommended recommendation recommendations widget widgets pagination pager masthead toolbar".split())
_PLAIN = frozenset("area bar block bottom box btn button buttons card container form group header holder icons inner item items link links list main module outer panel post posts primary secondary articles stories section site slot thread title top unit wrap wrapper".split())
_UNSEEN = frozenset(("hidden", "sr-only", "visually-hidden", "screen-reader-text", "skip-link"))
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _named(token: str, words: frozenset[str]) -> bool:
    """Whether a whole class or id token is one of ``words``, beside plain parts and numbers."""
    parts = [x for x in re.split(r"[-_]+", token.lower()) if x and not re.fullmatch(r"\d+(?:x\d+)?", x)]
    return any(x in words for x in parts) and all(x in words or x in _WORDS or x in _COMMENT_WORDS or x in _PLAIN for x in parts)


@lru_cache(4096)
def _unwanted(name: str, attributes: str) -> str:
    """Why an element holds no article text: "unseen", "comments", "named" or "" if it may hold some.
    Names tell nothing of headings and parts of sentences, ids only of containers."""
    found: dict[str, str] = {}
    for key, value in _ATTR.findall(attributes):
        found.setdefault(key.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] else value))
    classes = found.get("class", "").split()
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return "unseen"
    if any(x.lower() in _UNSEEN for x in classes) and not any(":" in x for x in classes):  # "hidden md:block" is seen
        return "unseen"
    if found.get("role", "").strip().lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"):
        return "named"
    if name in _HEADINGS or name in PHRASES:
        return ""
    tokens = classes + (found.get("id", "").split() if name in CONTAINERS else [])
    return "comments" if any(_named(x, _COMMENT_WORDS) for x in tokens) else "named" if any(_named(x, _WORDS) for x in tokens) else ""


class _Tags:
    """Finds where the tags of a page end that hold "<" or unpaired quotes.  Values that led nowhere
    are remembered, so broken pages take linear time too."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.lost: set[int] = set()
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place behind the tag whose attributes start at ``at``, or -1 if it is none.  A value
        without a closing quote, or one whose "closing" quote opens the next value, is loose."""
        page, start, seen = self.page, at, []
        while m := _STEP.match(page, at):
            if not m[1]:
                return m.end()
            if m.end() in self.lost:
                break
            seen.append(m.end())
            if self.last[m[1]] < m.end():
                break
            close = page.index(m[1], m.end())
            follows = page[close + 1 : close + 2]
            if page[close - 1] == "=" and close > m.end() and follows and follows not in "/>" and not follows.isspace() and (loose := _LOOSE.match(page, m.end())) and loose.end() <= close:
                return loose.end()
            at = close + 1
        self.lost.update(seen)
        loose = _LOOSE.match(page, start)
        return loose.end() if loose else -1


def _tokens(page: str) -> list[tuple[str, bool, str]]:
    """(name, is an end tag, attributes) of each tag and ("", False, text) of each text.  Raw elements
    leave a start tag alone; comments and declarations leave nothing."""
    out: list[tuple[str, bool, str]] = []
    at, n, tags = 0, len(page), None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[6] is not None:
            out.append(("", False, m[6]))
            continue
        closing, name, attributes = bool(m[1] or m[4]), m[2] or m[5], m[3]
        if name is None:
            continue
        if attributes is None:
            tags = tags or _Tags(page)
            end = tags.end(at)
            if end < 0:  # no tag; at the page's end it is one cut off
                if page.find("<", at) >= 0:
                    out.append(("", False, m[0]))
                    continue
                break
            attributes, at = page[at : end - 1], end
        name = name.lower()
        if name in RAW and not closing and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        out.append((name, closing, attributes))
    return out


def _ends(tokens: list[tuple[str, bool, str]]) -> tuple[list[int], bytearray]:
    """For each start tag the token that ends its element, and whether that is its own end tag;
    otherwise it is the tag that ends an outer element or implies the end, or the page's end."""
    end, own = [len(tokens)] * len(tokens), bytearray(len(tokens))
    stack: list[int] = []
    opened: dict[str, list[int]] = {}  # places in the stack
    blocks: list[int] = []

    def pop_to(depth: int, at: int) -> None:
        while len(stack) > depth:
            name = tokens[k := stack.pop()][0]
            if opened[name] and opened[name][-1] == len(stack):
                opened[name].pop()
                end[k] = at
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    for i, (name, closing, _) in enumerate(tokens):
        if not name or name in RAW:
            continue
        if name == "a" and not closing and (links := opened.get("a")):  # links do not nest
            end[stack[links.pop()]] = i
        if closing:
            if not (places := opened.get(name)):
                continue
            depth = places[-1]
            own[stack[depth]] = 1
            if name in BLOCKS or not blocks or blocks[-1] < depth:
                pop_to(depth, i)
            else:  # misnested: the blocks inside stay open
                end[stack[depth]] = i
                places.pop()
            continue
        if name in BLOCKS:
            while blocks and name in IMPLIED.get(tokens[stack[blocks[-1]]][0], ()):
                pop_to(blocks[-1], i)
        if name not in VOID:
            opened.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append(i)
    return end, own


class Line(NamedTuple):
    """One block of text.  ``weight``: characters outside links, none where links hold most of them.
    ``region`` counts article and main elements as odd numbers and what lies around them as even
    ones.  ``aside``: in an element that holds no article text.  ``empty``: start and end tags of
    layout elements since the line before, each a line without text; the line's own are not."""

    text: str
    weight: int
    region: int
    aside: bool
    empty: int


def lines(page: str, wrapped: bool = False) -> list[Line]:
    """The non-empty lines of a page, those of menus, footers and the like included.  ``wrapped``:
    an unwanted name of an element does not reach into articles in it, save for comments."""
    out: list[Line] = []
    parts: list[str] = []
    linked = region = inside = empty = 0
    link_end, in_open_link = -1, False
    in_header = aside_end = 0
    aside = own_start = False

    def flush() -> bool:
        """Ends a line; whether there is one."""
        nonlocal linked, empty
        text = " ".join("".join(parts).split())
        if text:
            n = len(text) - text.count(" ")
            out.append(Line(text, 0 if linked > LINK_SHARE * n else n, region, aside, max(0, empty - own_start)))
            empty = 0
        parts.clear()
        linked = 0
        return bool(text)

    tokens = _tokens(page)
    end, own = _ends(tokens)
    starts = [i for i, t in enumerate(tokens) if not t[1] and (t[0] in ARTICLE or t[0] == "body")]
    mains = [i for i in starts if tokens[i][0] == "main"]
    i = -1
    while (i := i + 1) < len(tokens):
        if aside_end and i >= aside_end:
            flush()
            aside_end = 0
        name, closing, attributes = tokens[i]
        if not name:
            aside = bool(aside_end) or in_header == 1
            text = html.unescape(attributes)
            parts.append(text)
            if i < link_end:
                linked += len("".join(text.split()))
            continue
        if name in BLOCKS:
            ended = flush()
            own_start = name in LAYOUT
            empty += own_start and not ended
            if in_open_link:
                link_end, in_open_link = i, False
        elif name == "br":
            parts.append(" ")
        if name in RAW and not closing:
            continue
        if closing:
            if aside_end:
                continue
            if name in ARTICLE and inside:
                inside -= 1
                region += 1 if not inside else 0
            elif name == "header":
                in_header = 0
            elif in_header == 2 and name in _HEADINGS:
                in_header = 1
            continue
        why = "control" if name in CONTROLS else "aside" if name in ASIDES else attributes and name not in VOID and name not in ("body", "html") and _unwanted(name, attributes)
        if why and (name != "main" or why == "unseen"):
            # an element without an end tag does not reach into an article, nor a wrapper of main into that
            until = [] if own[i] and why != "named" else mains if own[i] and not wrapped else starts
            k = bisect_right(until, i)
            reach = until[k] if k < len(until) and until[k] < end[i] else end[i] + own[i]
            if why in ("control", "unseen") or name not in BLOCKS:
                i = reach - 1
            elif not aside_end:
                aside_end = reach
            continue
        if aside_end:
            continue
        if name == "a":  # a link without end tag ends with its block
            link_end, in_open_link = end[i], not own[i]
        elif name in ARTICLE:
            region += 1 if not inside else 0
            inside += 1
            in_header = 0
        elif name == "header":
            in_header = 1
        elif in_header and name in _HEADINGS and inside:
            in_header = 2
    flush()
    return out


def select(found: list[Line]) -> list[int]:
    """The places of the lines that line blocks keep.

    The lines stand in page order among empty ones: as many as layout tags lie between two lines
    outside of articles, a whole window of them at the edges of articles and in place of a line
    aside.  (In an article a line aside is left out and interrupts nothing.)  A run starts at a
    surge, a line with weight, and ends at a dive, a window without any.  In articles each line has
    weight, as links may be text there; so a run holds lines of links between its ends too.

    A run is kept if its highest window reaches the surge level: SURGE characters, or half of the
    highest such window where none has so many.  A character in an article weighs as ARTICLE_WEIGHT
    others, and where there are any the level is at least an eighth of the highest window in one:
    text outside of articles must be twice as dense as the densest in them."""
    weights: list[int] = []  # what windows add up
    bounds: list[int] = []  # what surges and dives are seen by
    line_at: dict[int, int] = {}
    gap = inner = False
    for k, line in enumerate(found):
        if line.aside:
            gap = gap or not line.region % 2
            continue
        n = WINDOW if gap or inner != line.region % 2 else 0 if inner else min(WINDOW, line.empty)
        gap, inner = False, bool(line.region % 2)
        weights += [0] * n
        bounds += [0] * n
        line_at[len(weights)] = k
        weights.append(line.weight * (ARTICLE_WEIGHT if inner else 1))
        bounds.append(len(line.text) if inner else line.weight)
    heights, sums = ([sum(x[i : i + WINDOW]) for i in range(len(x))] for x in (weights, bounds))
    runs: list[tuple[int, int, int, bool]] = []  # surge point, dive point, highest window, in an article
    i = 0
    while i < len(bounds):
        if not bounds[i]:
            i += 1
            continue
        j = i
        while j < len(bounds) and sums[j]:
            j += 1
        runs.append((i, j, max(heights[i:j]), bool(found[line_at[i]].region % 2)))
        i = j
    top = [max((high for _, _, high, of in runs if of == kind), default=0) for kind in (False, True)]
    level = max(min(SURGE, top[0] / 2), top[1] / 8)
    return [line_at[p] for a, b, high, _ in runs if high >= level for p in range(a, b) if p in line_at]


def extract(page: str | None) -> str:
    """The kept lines of one page, joined by line feeds; empty for a null or empty page and one
    without text."""
    if not page:
        return ""
    found = lines(page)
    if all(x.aside for x in found):
        found = lines(page, wrapped=True)
    return "\n".join(found[k].text for k in select(found))


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Replace ``html_col`` by ``text_col``, the main text; other columns stay, one of the name
    ``text_col`` as ``text_col`` with "_input" behind.  Null or empty html gives an empty text;
    repeated rows are each extracted; an empty table gives none; no shuffle."""
    if text_col.lower() != html_col.lower():
        pages = keep_clashing(pages, text_col)
    fields = [f for f in pages.schema.fields if f.name != html_col]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = pa.array([extract(x.as_py()) for x in part[html_col]], pa.string())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), out], [*kept, text_col])

    return small_batches(pages).select(*(F.col(c) for c in kept), F.col(html_col)).mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType(), False)]))
