"""Main text of web pages by line-block distribution.

Markup is stripped: every tag of a block element ends a line, so each block's text is a line and neighbouring
tags leave empty lines; runs of empty lines are cut to `most_blank`. Scripts, styles, comments and what HTML
reserves for the surroundings of an article (navigation, page headers and footers, asides, forms, and blocks
named as adverts, notices, sidebars or reader comments) are stripped whole. Outside an article they leave a gap
of `gap` empty lines, and so do an article's own ends; inside one they leave nothing.

The text lengths of every `window` neighbouring lines are summed. A surge is a sum that reaches `least_chars`,
a dive the next sum of zero on either side of it; the lines between the dives around a surge are the text.
If no sum reaches the level, the stretch between dives with the most text is kept. On a page with an <article>,
lines outside every article count nothing, and lines of <main> only if they are not mostly links, so the tag
weighs lines and the distribution chooses among the stretches (a teaser card in an <article> of its own goes).

On a page without <article>, or inside a <main> that holds none, lines that are mostly links count nothing and
a stretch ends where the sum falls below the level. Shorter lines are kept if their container (the innermost
open div, section or the like) holds a kept line, so a heading or a last short section behind an advert stays
and short comments in blocks of their own go; runs of more than two link lines go. Comments in unnamed blocks
that are as long as paragraphs look like paragraphs and stay.

Defined results: null, empty and markup-only pages give an empty text; broken or unclosed markup is read
as far as it goes; nothing is cut at any length; equal pages give equal rows.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from starloom.llm.frames import add_struct
from starloom.llm.text import strings

FIELDS = StructType([StructField("text", StringType()), StructField("n_chars", LongType()), StructField("n_lines", IntegerType()), StructField("n_kept", IntegerType())])

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body br canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot"
    " th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas".split())
AROUND = frozenset("head nav footer aside form dialog menu button select fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole class tokens of blocks that surround an article.
_CLASS = re.compile(
    r"(?:(?:ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|cookie|cookies|consent|newsletter|subscribe|popup|modal|sidebar|widget|widgets|comment|comments"
    r"|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|social|share|sharing|related|recommended|recommendations|pagination|login|signup|search)"
    r"(?:[-_]{1,2}(?:ad|area|bar|banner|block|box|buttons?|container|content|form|inner|items?|left|links?|list|menu|notice|outer|panel|posts?|right|section|slot|thread|top|unit|widget|wrapper|wrap))?"
    r"|banner|notice|masthead|replies|disqus|disqus[-_]thread|pager|side|alert|(?:site|page|main|global)[-_](?:header|footer|nav|navigation|menu|sidebar))",
    re.I,
)
#: Whole ids of containers that surround an article; other ids name what a section is about.
_ID = re.compile(
    r"(?:ads?|advert|advertisement|cookies?|(?:cookie|consent|ad|top)[-_](?:banner|notice|bar|container)|newsletter|popup|modal|(?:left|right)?[-_]?sidebar|nav|navbar|navigation|menu|(?:main|site|top)[-_](?:nav|navigation|menu)"
    r"|breadcrumbs?|(?:site|page)?[-_]?footer|(?:site|page)[-_]header|masthead|comments?|comments?[-_](?:list|section|area|form|thread)|disqus[-_]thread|pagination)",
    re.I,
)
_ROLE = re.compile(r"(?:navigation|banner|complementary|contentinfo|search|alert|alertdialog|dialog|menu|menubar)", re.I)
#: Elements whose names never make them surrounding matter: text of their own, and the page's frame.
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote br html body main article".split())
#: Elements that hold paragraphs; a line belongs to the innermost open one.
_CONTAINERS = frozenset("html body main article section div td th center details".split())
_REPLY = re.compile(r"(?:comments?|reply|replies)(?:[-_]\w+)*", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What a tag holds up to its end, quoted parts whole; the match never steps back.
_INSIDE = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_QUOTES = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Params:
    """`window` lines are summed; sums from `least_chars` on are body text. Runs of empty lines are cut to `most_blank`,
    so with a window above it only a gap of `gap` lines parts two stretches of an article, and with a smaller window
    each block is a stretch of its own. A line with more than `most_links` of its characters in links counts nothing
    outside articles."""

    window: int = 3
    least_chars: int = 90
    most_links: float = 0.5
    most_blank: int = 2
    gap: int = 8


def _around(name: str, attributes: str, in_article: bool) -> bool:
    if name in AROUND or name == "header" and not in_article:
        return True
    named = name in BLOCKS and name not in _TEXT
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return name not in ("html", "body", "main", "article")
        if key == "class" and (named and any(map(_CLASS.fullmatch, value.split())) or name == "article" and any(map(_REPLY.fullmatch, value.split()))):
            return True
        if named and (key == "id" and _ID.fullmatch(value.strip()) or key == "role" and _ROLE.fullmatch(value.strip())):
            return True
    return False


#: What a line lies in.
OUTSIDE, IN_MAIN, IN_ARTICLE = 0, 1, 2


class Lines:
    """The lines of a page in order: texts, scopes, containers and shares of characters in links; empty ones have container -1."""

    def __init__(self, p: Params):
        self.p = p
        self.text: list[str] = []
        self.scope: list[int] = []
        self.held: list[int] = []
        self.links: list[float] = []
        self.blank = 0

    def add(self, line: str, scope: int, container: int, linked: str) -> None:
        """A line, or an empty one unless `most_blank` of them are there already."""
        if not line and self.blank >= self.p.most_blank:
            return
        self.blank = 0 if line else self.blank + 1
        self.text.append(line)
        self.scope.append(scope)
        self.held.append(container if line else -1)
        self.links.append(len(linked) / len(line) if line else 0.0)

    def part(self) -> None:
        """A gap that no window spans."""
        for _ in range(max(self.p.gap, self.p.window) - self.blank):
            self.text.append("")
            self.scope.append(OUTSIDE)
            self.held.append(-1)
            self.links.append(0.0)
        self.blank = max(self.p.gap, self.p.window)


class _Tags:
    """The markup of a page, found in one pass: comments, declarations and tags; what never closes is text.

    A tag ends at the first > outside quotes, or at its first > where its quotes never close. Where they do not, the ends for all
    further places are worked out once, from the page's last quote back to its first, so broken pages take no longer than others."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def _unquoted(self, at: int) -> int:
        """The first > outside quotes from here on, -1 if there is none."""
        if self.places is None:
            stop = _INSIDE.match(self.page, at).end()
            if stop < len(self.page) and self.page[stop] == ">":
                return stop
            self.places = [m.start() for m in _QUOTES.finditer(self.page, at)]
            self.ends = [-1] * (len(self.places) + 1)
            after: dict[str, int] = {}
            for k in range(len(self.places) - 1, -1, -1):
                c = self.page[self.places[k]]
                self.ends[k] = self.places[k] if c == ">" else self.ends[after[c] + 1] if c in after else -1
                after[c] = k
        return self.ends[bisect.bisect_left(self.places, at)]

    def __iter__(self):
        """(begin, end, whether it closes an element, name, attributes); the name is empty for what is not a tag."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!--", "<![CDATA["), at):
                mark = "-->" if page[at + 2] == "-" else "]]>"
                end = page.find(mark, at + (4 if mark == "-->" else 9))
                end = len(page) if end < 0 else end + 3
                at = (yield at, end, False, "", "") or end
                continue
            if at > self.last:
                at += 1
                continue
            closing = page.startswith("/", at + 1)
            m = _NAME.match(page, at + 1 + closing)
            if m is None:
                if page.startswith(("!", "?"), at + 1):
                    end = page.index(">", at) + 1
                    at = (yield at, end, False, "", "") or end
                else:
                    at += 1
                continue
            end = self._unquoted(m.end())
            end = (page.index(">", m.end()) if end < 0 else end) + 1
            at = (yield at, end, closing, m[0].lower(), page[m.end() : end - 1]) or end


def _clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""


def _next(tags, at: int):
    """The next piece of markup from here on."""
    try:
        return tags.send(at)
    except StopIteration:
        return None


def lines(page: str, p: Params = Params()) -> Lines:
    """The page's lines (see Lines)."""
    out = Lines(p)
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []
    skip = links = containers = 0
    scopes: list[int] = [OUTSIDE]

    def close():
        out.add(_clean(text), scopes[-1], stack[-1][3] if stack else 0, _clean(linked))
        text.clear()
        linked.clear()

    at, n, opened = 0, len(page), Counter()
    tags = iter(_Tags(page))
    found = next(tags, None)
    while True:
        stop = found[0] if found else n
        if not skip and stop > at:
            text.append(page[at:stop])
            if links:
                linked.append(page[at:stop])
        if found is None:
            break
        _, at, closing, name, attributes = found
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        found = _next(tags, at)
        if not name:
            continue
        if closing:
            # only names that are open are looked for, and what is passed over is closed, so all searches together take one step an element
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None) if opened[name] else None
            if depth is not None:
                if name in BLOCKS and not skip:
                    close()
                for element, around, scope, _ in reversed(stack[depth:]):
                    links -= element == "a"
                    opened[element] -= 1
                    if around:
                        text.clear()
                        linked.clear()
                        skip -= 1
                        if not skip and scopes[-1] != IN_ARTICLE:
                            out.part()
                    if scope != OUTSIDE:
                        close()
                        scopes.pop()
                        if scopes[-1] != IN_ARTICLE:
                            out.part()
                del stack[depth:]
            elif name in BLOCKS and not skip:
                close()
            continue
        if name in BLOCKS and not skip:
            close()
        if name in RAW:
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        around = _around(name, attributes, scopes[-1] != OUTSIDE)
        if around and not skip:
            close()
        skip += around
        scope = OUTSIDE if skip else IN_ARTICLE if name == "article" else IN_MAIN if name == "main" else OUTSIDE
        if scope != OUTSIDE:
            if scopes[-1] != IN_ARTICLE:
                out.part()
            scopes.append(max(scope, scopes[-1]))
        if name in ("p", "li") and stack and stack[-1][0] == name:
            stack.pop()
            opened[name] -= 1
        opened[name] += 1
        links += name == "a"
        containers += name in _CONTAINERS
        stack.append((name, around, scope, containers if name in _CONTAINERS else stack[-1][3] if stack else 0))
    if not skip:
        close()
    return out


def line_blocks(sizes: np.ndarray, window: int, surge: int = 1, dive: int = 1) -> list[tuple[int, int]]:
    """Stretches of lines, [first, end), between dives around a surge: maximal runs of windows with sums of `dive` or
    more of which one reaches `surge`, without the window's run-in and run-out."""
    if not len(sizes):
        return []
    padded = np.concatenate([np.zeros(window - 1, np.int64), sizes, np.zeros(window - 1, np.int64)])
    total = np.concatenate([[0], np.cumsum(padded)])
    sums = total[window:] - total[:-window]
    full = np.concatenate([[False], sums >= dive, [False]])
    begin = np.flatnonzero(~full[:-1] & full[1:])
    end = np.flatnonzero(full[:-1] & ~full[1:])
    return [(max(0, int(a)), min(len(sizes), int(b) - window + 1)) for a, b in zip(begin, end) if sums[a:b].max() >= surge]


def _articles(sizes: np.ndarray, p: Params) -> np.ndarray:
    """Which lines of a page with an article are its text; sizes are 0 for lines that count nothing."""
    found = line_blocks(sizes, p.window, p.least_chars)
    if not found:
        found = sorted(line_blocks(sizes, p.window), key=lambda x: -int(sizes[x[0] : x[1]].sum()))[:1]
    chosen = np.zeros(len(sizes), dtype=bool)
    for a, b in found:
        chosen[a:b] = sizes[a:b] > 0
    return chosen


def _body(sizes: np.ndarray, held: np.ndarray, shares: np.ndarray, p: Params) -> np.ndarray:
    """Which lines of a page without an article tag are its text."""
    if not len(sizes):
        return np.zeros(0, dtype=bool)
    weights = np.where(shares > p.most_links, 0, sizes)
    chosen = np.zeros(len(sizes), dtype=bool)
    for a, b in line_blocks(weights, p.window, p.least_chars, p.least_chars):
        chosen[a:b] = weights[a:b] > 0
    # where short lines alone reach the level, each line of the sum has its part in it
    short = np.where(weights < p.least_chars, weights, 0)
    full = np.convolve(short, np.ones(p.window, np.int64)) >= p.least_chars
    chosen |= (short > 0) & (np.convolve(full, np.ones(p.window, np.int64), "valid") > 0)
    if not chosen.any():
        blocks = line_blocks(weights if weights.any() else sizes, p.window)
        for a, b in sorted(blocks, key=lambda x: -int(sizes[x[0] : x[1]].sum()))[:1]:
            chosen[a:b] = sizes[a:b] > 0
        return chosen
    at = np.flatnonzero(sizes)
    link = shares[at] > p.most_links
    run = np.cumsum(np.concatenate([[True], link[1:] != link[:-1]])) - 1
    listed = link & (np.bincount(run)[run] > 2)
    # short lines of the containers whose own lines reach the level stay with them
    chosen[at] |= np.isin(held[at], np.unique(held[chosen])) & ~listed
    return chosen


def main_text(page: str, p: Params = Params()) -> tuple[str, int, int]:
    """The main text, the number of lines that count and the number kept."""
    found = lines(page, p)
    sizes = np.array([len(x) for x in found.text], dtype=np.int64)
    scope, shares = np.array(found.scope, dtype=np.int64), np.array(found.links)
    if (scope[sizes > 0] == IN_ARTICLE).any():
        sizes = np.where((scope == IN_ARTICLE) | (scope == IN_MAIN) & (shares <= p.most_links), sizes, 0)
        chosen = _articles(sizes, p)
    else:
        if (scope[sizes > 0] == IN_MAIN).any():
            sizes = np.where(scope == IN_MAIN, sizes, 0)
        # empty lines between blocks do not count here, gaps do
        seen = (sizes > 0) | _gaps(found.text, p)
        chosen = np.zeros(len(sizes), dtype=bool)
        chosen[seen] = _body(sizes[seen], np.array(found.held, dtype=np.int64)[seen], shares[seen], p)
    kept = [found.text[i] for i in np.flatnonzero(chosen)]
    return " ".join(kept), int((sizes > 0).sum()), len(kept)


def _gaps(texts: list[str], p: Params) -> np.ndarray:
    """Which empty lines belong to a gap."""
    empty = np.array([not x for x in texts], dtype=bool)
    run = np.cumsum(np.concatenate([[True], empty[1:] != empty[:-1]])) - 1 if len(empty) else np.zeros(0, np.int64)
    return empty & (np.bincount(run, minlength=1)[run] >= max(p.gap, p.window)) if len(empty) else empty


def extract(pages: DataFrame, p: Params = Params(), html_col: str = "html", out: str = "main", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of pages and a struct `out`: text, n_chars (code points), n_lines and n_kept."""

    def compute(batch: pa.RecordBatch) -> list:
        rows = [main_text(x, p) for x in strings(batch.column(html_col)).to_pylist()]
        return [[r[0] for r in rows], [len(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]]

    return add_struct(pages, out, FIELDS, compute, text=html_col, carry=carry)
