"""The page query against another parser (the standard library's) and line windows counted one by one."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from starloom.llm import html, queries

SKIPPED = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "fieldset", "script", "style"}


class Page(HTMLParser):
    """Lines of a page: (text, inside an article). Only for markup whose elements of SKIPPED, articles and divs are closed."""

    def __init__(self, page, blanks=2, gap=8):
        super().__init__(convert_charrefs=True)
        self.lines, self.words, self.deep, self.article, self.blanks, self.gap, self.dropped = [], [], 0, 0, blanks, gap, []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        line = re.sub(r"\s+", " ", "".join(self.words)).strip()
        self.words = []
        if line or any(x for x, _ in self.lines[-self.blanks :]) or len(self.lines) < self.blanks:
            self.lines.append((line, self.article > 0))

    def hole(self):
        self.lines += [("", False)] * self.gap

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        drop = tag in SKIPPED or tag == "header" and not self.article or tag == "div" and named.get("class") == "ad"
        if tag in html.BLOCKS and not self.deep:
            self.end()
        if tag == "div" or tag in SKIPPED or tag == "header":
            self.dropped.append(drop)
            self.deep += drop
        if tag == "article" and not self.deep:
            if not self.article:
                self.hole()
            self.article += 1

    def handle_endtag(self, tag):
        if tag in html.BLOCKS and not self.deep:
            self.end()
        if (tag == "div" or tag in SKIPPED or tag == "header") and self.dropped and self.dropped.pop():
            self.deep -= 1
            self.words = []
            if not self.deep and not self.article:
                self.hole()
        if tag == "article" and not self.deep and self.article:
            self.article -= 1
            if not self.article:
                self.hole()

    def handle_data(self, data):
        if not self.deep:
            self.words.append(data)


def brute(page, window=3, level=90):
    """Windows around a surge, one by one, out to the next sum of zero on both sides."""
    lines = Page(page).lines
    size = [len(x) if inside else 0 for x, inside in lines]
    total = {k: sum(size[max(0, k) : max(0, k + window)]) for k in range(1 - window, len(lines))}
    stretches, here = [], []
    for k in [*total, None]:
        if k is not None and total[k] > 0:
            here.append(k)
        elif here:
            stretches.append(here)
            here = []
    good = [s for s in stretches if max(total[k] for k in s) >= level] or sorted(stretches, key=lambda s: -sum(size[i] for i in {i for k in s for i in range(max(0, k), min(len(size), k + window))}))[:1]
    kept = sorted({i for s in good for k in s for i in range(max(0, k), min(len(size), k + window)) if size[i]})
    return " ".join(lines[i][0] for i in kept)


def test_query_equals_windows_counted_one_by_one(spark, sf):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        want = brute(pages[r.page_id][1])
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id][0], want, len(want))


@pytest.mark.parametrize("window", [1, 2, 3, 5])
@pytest.mark.parametrize("level", [1, 90, 10**9])
def test_windows_and_levels_decide(spark, sf, window, level):
    rows = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    p = html.Params(window=window, least_chars=level)
    got = [html.main_text(x, p)[0] for x in rows]
    assert got == [brute(x, window, level) for x in rows]
    if window == 1 and level > 1:
        assert sum(a != brute(x) for a, x in zip(got, rows)) > len(rows) / 2


LONG = "word " * 40
CONTRACT = [
    ("<article><p>a</p><p class='alert'>Flood alert issued today.</p><p>" + LONG + "</p></article>", "a Flood alert issued today. " + LONG.strip()),
    ("<article><p>Read <span class='share'>this</span> and <em class=ad>that</em>.</p><p>" + LONG + "</p></article>", "Read this and that. " + LONG.strip()),
    ("<article><p>" + LONG + "</p><div class=ad>buy</div><p>Be.</p></article>", LONG.strip() + " Be."),
    ("<main><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><article><h1>T</h1><p>" + LONG + "</p></article></main>", "T " + LONG.strip()),
    ("<main><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li></ul><div><h1>T</h1><p>" + LONG + "</p></div></main>", "T " + LONG.strip()),
    ("<article><h1>T</h1><p>" + LONG + "</p></article><article><h2>Read on</h2><p>Another story.</p></article>", "T " + LONG.strip()),
    ("<article><h1>Short</h1><p>Be.</p></article><article><p>x</p></article>", "Short Be."),
    ("<article><div><div><section><h2>A</h2></section></div></div><div><div><p>Short end.</p></div></div><p>" + LONG + "</p></article>", "A Short end. " + LONG.strip()),
    ("<article></article><div><p>" + LONG + "</p></div>", LONG.strip()),
    ("<p> a&nbsp;b&amp;c</p>", "a b&c"),
]


@pytest.mark.parametrize("page, want", CONTRACT)
def test_contract_pages(page, want):
    assert html.main_text(page)[0] == want


#: The same markup as one backtracking pattern: right, but quadratic where tags never close.
SLOW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
BITS = "<p> </p> <a_href='x>y'> </a> <b <a_\" <i_' > \" ' <!-- --> <!x> <!x <?y </div> <div_class=ad> <article> </article> words_here <br/> <_3_ <![CDATA[ ]]> <a_title=\"<b>z</b>\"> &amp;".replace("_", "\0").split()


def test_markup_equals_one_pattern_on_broken_pages():
    rng = random.Random(1)
    for _ in range(3000):
        page = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 30))).replace("\0", " ")
        want = [(m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or "") for m in SLOW.finditer(page)]
        assert list(html._Tags(page)) == want, page


@pytest.mark.parametrize("page", ["<a " * 330_000, '<a "' * 250_001 + ">", "<!x" * 330_000, "<b>" * 140_000 + "</i>" * 140_000, "<a \">\"" * 160_000 + "'>", "<" * 10**6, "<!--" * 250_000, "<p>x" * 200_000, "<div>" * 200_000, "&#" * 500_000])
def test_a_megabyte_of_broken_markup_takes_seconds(page):
    begin = time.process_time()
    html.main_text(page)
    assert time.process_time() - begin < 15


def test_windows_choose_between_short_blocks():
    """Without tags that say what the article is, the windows of lines do: a wide one joins short lines to a surge, a narrow one does not."""
    page = "<body>" + "".join(f"<div><p>{x}</p></div>" for x in ["Home page", LONG, *["a line of twenty chars"] * 6, LONG, "Imprint"]) + "</body>"
    texts = {w: html.main_text(page, html.Params(window=w))[0] for w in (1, 2, 9)}
    assert "twenty" in texts[9] and "twenty" not in texts[2] and all(LONG.strip() in t for t in texts.values())
    assert len(set(texts.values())) > 1
