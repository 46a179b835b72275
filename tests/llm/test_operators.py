"""Operators against brute force, exact round trips and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.llm import components, fingerprint, html, huffman, neardup, packing, pieces, queries, secrets, text, tokens


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_substring_dedup(spark, sf, documents):
    words = {i: (t or "").encode().split() for i, t in documents}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = by_id(queries.op1_substring_dedup(spark, sf))
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(left).hexdigest())


def test_hot_buckets_are_divided_and_change_nothing(spark, sf):
    """Different windows around one short passage share its minimiser; equal ones still meet in a divided bucket."""
    from starloom.llm import substring

    rng = random.Random(6)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    notice, long_ = " ".join(f"n{k}" for k in range(20)), " ".join(f"r{k}" for k in range(50))
    rows = [(k, f"{own(30)} {notice} {own(30)}" + (f" {long_}" if k % 3 == 0 else "")) for k in range(300)] + [(999, long_)] * 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    one, many = (sorted(map(str, substring.remove_repeated(docs, buckets=4, most=m).collect())) for m in (10**9, 200))
    assert one == many and sum("n_removed=50" in x for x in one) == 104
    texts = docs.selectExpr("text", "doc_id a", "doc_id b")
    hot = substring._hot(texts, 35, 4, 200)
    blobs = texts.mapInArrow(substring._windows(35, 4, hot), substring._BLOBS).collect()
    by = Counter()
    for r in blobs:
        by[r.bucket] += (len(r.hashes) + len(r.known)) // 8
    assert hot and max(by.values()) < 300


def test_license_scan(spark, sf):
    from compare import rows, sql_rows

    assert rows(queries.op2_license_scan(spark, sf)) == sql_rows(queries.ORACLES["op2_license_scan"], sf)


def test_license_spellings(spark):
    from starloom.llm import licenses

    rows = [(1, "MIT LICENCE\n\nCopyright (c) 2020 Somebody\n\n" + licenses._MIT.upper().replace(",", " ")), (2, licenses._ISC), (3, licenses._ISC + " more"), (4, "released under the mit licence")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")))
    assert [got[i].license_id for i in (1, 2, 3, 4)] == ["MIT", "ISC", None, "MIT"]


def test_license_full_texts(spark):
    """Whole texts are known by default, however they are wrapped, in Spark and in the SQL."""
    from pathlib import Path

    import duckdb

    from starloom.llm import licenses

    files = sorted(Path(licenses.__file__).parent.glob("known_licenses/*.txt"))
    texts = {f.stem: f.read_text() for f in files}
    rows = [(k, "Copyright (c) 2020 Somebody\n\n" + ("\n".join(x.strip().upper() for x in t.split("\n")) if odd else t)) for k, t in texts.items() for odd in (0, 1)]
    rows = [(2 * k + j, t, name) for k in range(len(texts)) for j, (name, t) in enumerate(rows[2 * k : 2 * k + 2])]
    rows.append((1000, texts["Apache-2.0"].partition("END OF TERMS")[0], "Apache-2.0"))
    got = by_id(licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")))
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id int, text varchar)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    sql = {r[0]: r for r in db.execute(licenses.oracle()).fetchall()}
    for i, _, name in rows:
        assert got[i].license_id == name.removesuffix("-UC") == sql[i][2] and got[i].canonical_sha256 == sql[i][1]
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {r.license_id for r in got.values()}


def test_license_variable_parts(spark):
    """Another holder and a left-out or added title change nothing; another clause does."""
    from pathlib import Path

    from starloom.llm import licenses

    bsd = (Path(licenses.__file__).parent / "known_licenses/BSD-3-Clause.txt").read_text()
    own = re.sub(r"(?s)Neither the name.*?nor the names", "Neither the name of Example & Sons, Ltd. nor the names", bsd)
    own = re.sub(r"(?s)PROVIDED BY .*? .AS IS", "PROVIDED BY EXAMPLE AND SONS ''AS IS", own)
    zlib = (Path(licenses.__file__).parent / "known_licenses/Zlib.txt").read_text()
    rows = [(1, "BSD 3-Clause License\n\nCopyright (c) 2021, Example\nAll rights reserved.\n\n" + own), (2, "The zlib License\n\n" + zlib), (3, zlib.replace("altered", "changed")), (4, "The MIT License (MIT)\n\nCopyright (c) 1999 X\n\n" + licenses._MIT)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")))
    assert [got[i].license_id for i in (1, 2, 3, 4)] == ["BSD-3-Clause", "Zlib", None, "MIT"]


def test_packing(spark, sf, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default("word_bpe_49k.json"))
    by, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in queries.op3_best_fit_packing(spark, sf).collect():
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in documents:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert sorted(by[i]) == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.02 * -(-total // 2048) + 1


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_fits(sizes):
    where, offset = packing.sum_of_squares(np.array(sorted(sizes, reverse=True)), 50)
    used = np.bincount(where, weights=sorted(sizes, reverse=True))
    assert used.max() <= 50 and len(used) <= 1.25 * -(-sum(sizes) // 50) + 2


def test_fingerprints(spark, sf, documents):
    got = by_id(queries.op4_document_fingerprints(spark, sf))
    down = documents[::-1]
    for k, (i, t) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (fingerprint.winnow([x])[0][0] for x in (t, changed, after))
        assert got[i].fingerprint == fingerprint.shown(a) and got[i].edited_fingerprint == fingerprint.shown(b)
        assert got[i].near_edited == fingerprint.likeness(a, b) and got[i].near_next == fingerprint.likeness(a, c)


@given(st.text("ab", max_size=80))
@settings(max_examples=100, deadline=None)
def test_winnowing_picks_rightmost_minimum(t):
    p = fingerprint.Params(gram=3, window=4)
    hashes, places = fingerprint.winnow(["xyz", t, "q"], p)[1]
    if len(t) < 3:
        assert len(places) == (len(t) > 0)
        return
    value = {}
    for g in range(len(t) - 2):
        value[g] = int(text.mix(text.rolling(np.array([ord(c) for c in t[g : g + 3]], np.uint64), 3))[0]) >> 24
    want = []
    for a in range(max(1, len(value) - 3)):
        window = [k for k in range(a, min(a + 4, len(value)))]
        k = max(window, key=lambda k: (-value[k], k))
        if not want or want[-1] != k:
            want.append(k)
    assert places.tolist() == want and hashes.tolist() == [value[k] for k in want]


def test_token_files(spark, sf, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default("word_bpe_49k.json"))
    got, at = by_id(queries.op5_token_binary(spark, sf)), 0
    for i, t in documents:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.randoms())
@settings(max_examples=40, deadline=None)
def test_huffman_blocks(counts, rnd):
    lengths = huffman.code_lengths(np.array(counts))
    assert lengths.max() <= 16 and (2.0**-lengths).sum() <= 1 + 1e-12
    code = huffman.Code(np.arange(len(counts)) * 7, lengths)
    ids = np.array([rnd.randrange(len(counts)) * 7 for _ in range(rnd.randrange(1, 900))])
    payload, marks = huffman.encode_block(ids, *code.encoder())
    assert huffman.decode_block(payload, marks, len(ids), *code.decoder()).tolist() == ids.tolist()


def test_package_merge_is_optimal_when_unlimited():
    import heapq

    rng = random.Random(1)
    counts = [rng.randint(1, 50) for _ in range(40)]
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (huffman.code_lengths(np.array(counts)) * counts).sum() == cost


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a>Home</a></nav><article><h1>Ti&amp;tle</h1><p>One  <b>tw</b>o\n three<br>four<p>Be.</article><footer>f</footer>", "Ti&tle One two three four Be."),
    ("<main><article><header><h1>H</h1></header><p>a<div class='ad'>buy</div><p>b<form>x</form><aside>s</aside>c</article><article class=\"comment\">no</article></main>", "H a b c"),
    ("<div id='menu'>Home</div><div><h2>T</h2><p>" + "word " * 40 + "</p><p>Be.</p></div><section id=comments><p>" + "bad " * 60 + "</p></section>", "T " + "word " * 40 + "Be."),
    ("<article><p>x<script>var a='</p>';</script><style>p{}</style><!-- c --><p>y &lt;z&gt; &#233;</article>", "x y <z> é"),
    ("", ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_html(page, want):
    assert html.main_text(page)[0] == want


TEXT_OF_ITS_OWN = [
    '<div style="overflow:hidden">x</div>', '<p><a href="/hidden-valley">x</a></p>', '<p><a href="/x?id=search">x</a></p>', '<div data-id="ad">x</div>', "<div title='class=ad hidden'>x</div>",
    '<h2 id="related-work">x</h2>', '<h2 id="side-effects">x</h2>', '<h2 id="search">x</h2>', '<section id="related-work">x</section>', '<div class="widget-free text">x</div>',
    '<p class="notice">x</p>', '<div data-hidden>x</div>', '<section id="search">x</section>',
]
SURROUNDING = ['<div class="text ad">x</div>', "<div id=comments>x</div>", "<div role='navigation'>x</div>", "<p hidden>x</p>", '<div aria-hidden="true">x</div>', '<ul class="share-buttons">x</ul>', '<div CLASS="site-footer">x</div>']


@pytest.mark.parametrize("part", TEXT_OF_ITS_OWN + SURROUNDING)
def test_html_names_surrounding_matter_by_whole_tokens(part):
    assert html.main_text(f"<article><p>a</p>{part}<p>b</p></article>")[0] == ("a x b" if part in TEXT_OF_ITS_OWN else "a b")


LONG, LINKS = "word " * 40, "<ul>" + "<li><a href='/a'>A link of the page to another</a></li>" * 5 + "</ul>"
UNMARKED = [
    (f"<body><div>{LINKS}</div><div><h1>T</h1><p>{LONG}</p></div></body>", f"T {LONG.strip()}"),
    (f"<body><div><h1>T</h1><p>{LONG}</p>{LINKS}</div><div><p>Nice post!</p></div><div><p>I agree</p></div></body>", f"T {LONG.strip()}"),
    (f"<body><div><h1>T</h1><p>{LONG}</p><div class=ad>buy</div><h2>End</h2><p>Short last.</p></div><div>So true</div></body>", f"T {LONG.strip()} End Short last."),
    (f"<p>{LONG}</p><p>See <a href='/b'>this</a>.</p><p><a href='/c'>Source</a></p><p>{LONG}</p>", f"{LONG.strip()} See this. Source {LONG.strip()}"),
    ("<div>" + "s " * 20 + "</div><div>" + "t " * 20 + "</div><div>" + "u " * 20 + "</div><div>" + "v " * 20 + "</div>", " ".join("s" * 20 + "t" * 20 + "u" * 20 + "v" * 20)),
    ("<p>Short page.</p>", "Short page."),
    ("<p><a href='/a'>Only a link</a></p>", "Only a link"),
]


@pytest.mark.parametrize("page, want", UNMARKED)
def test_html_line_blocks_choose_the_text_of_pages_without_article(page, want):
    assert html.main_text(page)[0] == want


def test_near_duplicates(spark, sf, documents):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in documents:
        w = (t or "").encode().translate(low).split()
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) and 100 * min(a, b) >= 80 * max(a, b):
                x = len(sets[i] & sets[j])
                if 100 * x >= 80 * (a + b - x):
                    p, q = sorted((root(i), root(j)))
                    up[q] = p
    for i, r in by_id(queries.op7_minhash_near_dedup(spark, sf)).items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), root(i), root(i) == i)


def test_blocks_of_a_large_group_change_nothing(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        w = [f"v{k}" for k in range(60)]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, many = (by_id(neardup.near_duplicates(docs, neardup.Params(shingle=2, group_shingles=g))) for g in (10**6, 900))
    assert {i: r.component_id for i, r in one.items()} == {i: r.component_id for i, r in many.items()}


def test_chance_collisions_do_not_chain_groups(spark):
    """Sets of which neighbours in a chain share half: bands join some of them, likely links none; real links stay."""
    words = [f"c{k}" for k in range(6000)]
    rows = [(i, " ".join(words[i * 30 : i * 30 + 90])) for i in range(150)]
    rows += [(1000 + i, rows[i][1].replace(f"c{i * 30} ", "z ")) for i in range(0, 150, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = neardup.Params(shingle=2, rows=2, bands=64)
    keyed = docs.selectExpr("doc_id a", "doc_id b", "doc_id id", "text")
    sketch = keyed.mapInArrow(neardup._sketched(p), "a bigint, b bigint, id bigint, sid binary, n bigint, keys binary, registers binary").cache()
    banded = sketch.mapInArrow(neardup._banded(p.bands), "key bigint, sid binary")
    size = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("sid").alias("lead")).filter("size > 1")
    led = banded.join(size, "key").cache()
    stars = components.components(led.selectExpr("sid u", "lead v")).groupBy("root").count().agg(F.max("count")).first()[0]
    likely = components.components(neardup._proposed(led, sketch, p)).groupBy("root").count().agg(F.max("count")).first()[0]
    assert stars > 100 and likely <= 8
    got = by_id(neardup.near_duplicates(docs, p))
    assert all(got[1000 + i].component_id == i for i in range(0, 150, 3)) and sum(r.kept for r in got.values()) == 150
    # crowded buckets keep their stars and nothing else changes
    crowded = by_id(neardup.near_duplicates(docs, neardup.Params(shingle=2, rows=2, bands=64, bucket_classes=1)))
    assert {i: r.component_id for i, r in crowded.items()} == {i: r.component_id for i, r in got.items()}


def test_sketches_merge_and_estimate():
    p, rng = neardup.Params(), np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**62, 3000, dtype=np.uint64))
    sketch = lambda v: neardup.registers(v, np.array([0, len(v)]), p)[0]
    assert (np.maximum(sketch(x[:1800]), sketch(x[1200:])) == sketch(x)).all()
    equal = (sketch(x[:2700]) == sketch(x[300:])).mean()
    assert abs(equal - 0.8) < 0.15


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def plain_spans(t):
    """(start, place of the kind, end, kind) by regular expressions written anew, without pre-checks."""
    low, found = t.translate({c: c + 32 for c in range(65, 91)}), []
    for m in re.finditer("(?:password|passwd|secret|token|apikey|api_key)[\"']?[ ]*[:=][ ]*[\"']?([a-z0-9+/_.=-]+)", low):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for place, kind, alphabet, least, head in ((1, "access", "A-Z0-9", 20, "AKIA"), (2, "hex", "0-9a-f", 24, "")):
        for m in re.finditer(f"{head}[{alphabet}]+", t):
            if m.end() - m.start() >= least:
                found.append((m.start(), place, m.end(), kind))
    return sorted(found)


def test_secrets(spark, sf, documents):
    got = by_id(queries.op8_secret_scan(spark, sf))
    for i, t in documents:
        f = plain_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in f)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[3] == k for x in f) for k in secrets.KINDS)
    again = by_id(queries.op8_secret_scan(spark, sf))
    assert again == got


SECRET = 'PassWord = "abc" api_key:abcdef1 é AKIA' + "B" * 16 + " " + "0f" * 12 + " token=short"


def test_secret_ledger_scans_each_pair_once(spark, tmp_path, monkeypatch):
    kinds = [(k, SECRET[a:b]) for a, b, k in secrets.find_spans(SECRET)]
    assert kinds == [("assign", "api_key:abcdef1"), ("access", "AKIA" + "B" * 16), ("hex", "0f" * 12)]
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([("a", 1, SECRET), ("b", 1, SECRET), ("c", 1, "x"), ("c", 2, "secret: abcdefg"), ("d", 1, None)], "path string, version int, text string")
    assert secrets.read_ledger(spark, path) is None
    rows = lambda rules=secrets.ALL: secrets.read_ledger(spark, path, rules).count()
    first = [(r.path, r.version, len(r.spans)) for r in secrets.scan(docs.filter("version = 1"), path).orderBy("path").collect()]
    assert first == [("a", 1, 3), ("b", 1, 3), ("c", 1, 0), ("d", 1, 0)] and rows() == 2 * 3
    # the same texts again, then one new version: nothing and one blob are scanned
    assert secrets.unseen(docs.filter("version = 1"), secrets.read_ledger(spark, path)).count() == 0
    assert secrets.unseen(docs, secrets.read_ledger(spark, path)).count() == 2
    for bound in (secrets.BROADCAST_BLOBS, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(secrets, "BROADCAST_BLOBS", bound)
        found = {(r.path, r.version): [s.kind for s in r.spans] for r in secrets.scan(docs, path).collect()}
        assert found == {("a", 1): ["assign", "access", "hex"], ("b", 1): ["assign", "access", "hex"], ("c", 1): [], ("c", 2): ["assign"], ("d", 1): []}
        assert rows() == 2 * 4
    newer = (secrets.Rules(version="base-2"),)
    assert secrets.unseen(docs, secrets.read_ledger(spark, path, newer), newer).count() == 4
    changed = (secrets.Rules(rules=secrets.BASE.rules[:1]),)
    assert changed[0].version == secrets.BASE.version and changed[0].name != secrets.BASE.name
    assert secrets.scan(docs, path, changed).count() == 5 and rows(changed) == 4 and rows() == 2 * 4
    # rows written anew are the same rows, in few files
    before = sorted(map(str, secrets.read_ledger(spark, path).collect()))
    secrets.compact(spark, path)
    assert sorted(map(str, secrets.read_ledger(spark, path).collect())) == before and not (tmp_path / "ledger.old").exists()
    # code that scans in another way scans all again
    monkeypatch.setattr(secrets, "find_spans", lambda text, rules: [(0, 1, "hex")] if text else [])
    assert sorted(len(r.spans) for r in secrets.scan(docs, path, (secrets.BASE,)).collect()) == [0, 1, 1, 1, 1]


def test_a_scan_reads_its_own_blobs_of_a_large_ledger(spark, tmp_path, monkeypatch):
    """What a run takes from the ledger does not grow with the ledger, whether ids are broadcast or not; without a place nothing is kept."""
    path = str(tmp_path / "ledger")
    many = spark.range(2000).selectExpr("id path", "concat('password: longsecret', id) text")
    secrets.update(many, path)
    few = many.filter("path < 3").unionByName(spark.createDataFrame([(9, "token = abcdefg")], "path bigint, text string"))
    for bound in (secrets.BROADCAST_BLOBS, 1):
        monkeypatch.setattr(secrets, "BROADCAST_BLOBS", bound)
        own = secrets.own_blobs(few, secrets.read_ledger(spark, path))
        assert own.count() == 3 * len(secrets.ALL) and secrets.unseen(few, own).count() == len(secrets.ALL)
        assert sorted((r.path, len(r.spans)) for r in secrets.findings(few, secrets.update(few.filter("path < 3"), path)).collect()) == [(0, 1), (1, 1), (2, 1), (9, 0)]
    spark.conf.set(secrets.SETTING, path)
    try:
        assert {len(r.spans) for r in secrets.scan(few).collect()} == {1}
        assert secrets.read_ledger(spark, path).count() == 2001 * len(secrets.ALL)
    finally:
        spark.conf.unset(secrets.SETTING)
    assert {len(r.spans) for r in secrets.scan(few).collect()} == {1} and secrets.read_ledger(spark, path).count() == 2001 * len(secrets.ALL)


def test_marked_keys_are_added_and_base_spans_stay(spark, tmp_path):
    marked = {
        "code_host": "ghp_" + "a1B2" * 9, "chat": "xoxb-123456789012-abc", "payment": "sk_live_" + "a1" * 10, "cloud": "AIza" + "x" * 35,
        "web_token": "eyJhbGciOiJI.eyJzdWIiOiIx.c2ln", "private_key": "-----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----",
    }
    docs = spark.createDataFrame([(k, f"see {v} or {SECRET}") for k, v in marked.items()], "kind string, text string")
    for r in secrets.scan(docs, str(tmp_path / "ledger")).withColumn("clean", secrets.redact(F.col("text"), F.col("spans"))).collect():
        got = [(s.kind, r.text[s.start : s.end]) for s in r.spans]
        assert got[0] == (r.kind, marked[r.kind]) and [k for k, _ in got[1:]] == ["assign", "access", "hex"]
        assert r.clean.count("[REDACTED]") == 4 and marked[r.kind] not in r.clean


def test_a_hot_blob_is_joined_by_broadcast(spark):
    from starloom.llm.shared import joined_by_hot_key

    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(k, k) for k in range(1, 400)], "k int, i int")
    table = spark.createDataFrame([(0, "hot"), (5, "five")], "t int, v string")
    got = [(r.k, r.i, r.v) for r in joined_by_hot_key(rows, "k", table, "t").collect()]
    assert len(got) == 899 and sum(v == "hot" for _, _, v in got) == 500 and [x for x in got if x[2] == "five"] == [(5, 5, "five")]


def test_wider_rules_scan_texts_that_the_base_rules_pass_over():
    wider = secrets.Rules("wide", (("assign", r"(pwd|bearer)[:=]([A-Za-z0-9]+)", 6, 2), ("hex", r"[0-9A-F]+", 24, 0), ("access", r"ASIA[A-Z0-9]+", 20, 0)))
    t = "pwd=abcdef1 " + "0F" * 12 + " ASIA" + "B" * 16
    assert secrets.find_spans(t) == [] and [k for _, _, k in secrets.find_spans(t, wider)] == ["assign", "hex", "access"]


def test_sentencepiece(spark, sf, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokens.default("piece_bpe_32k.model"))
    got = by_id(queries.op9_sentencepiece(spark, sf))
    for i, t in documents:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


ODD = ["", " ", "  a  b ", "a\n\nb\n c", "\n", "x\ty\r\nz", "▁a ▁ b", "漢字 🙂🙂 é", "<s> </s>", "a\x00b", "   ", "\n  x", "é" * 50]


def test_piece_spans_cover_the_source():
    m = pieces.model(tokens.default("piece_bpe_32k.model"))
    array = text.strings(pa.array(ODD))
    ids, cuts = m.encode(array)
    low, high = m.all_spans(array, ids, cuts)
    for k, t in enumerate(ODD):
        a, b = cuts[k], cuts[k + 1]
        assert ids[a:b].tolist() == m.lib.encode(t)
        own = m.spans(t.encode(), ids[a:b])
        assert own[0].tolist() == low[a:b].tolist() and own[1].tolist() == high[a:b].tolist()
        assert (low[a + 1 : b] == high[a : max(a, b - 1)]).all() and (a == b or high[b - 1] == len(t.encode()))


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array with the keys a -> X and ab -> YZ."""
    units = [0] * 512
    unit = lambda offset, label, leaf: (offset << 10) | (int(leaf) << 8) | label
    units[0] = unit(256, 0, False)
    a = 256 ^ ord("a")
    units[a] = unit(a ^ 400, ord("a"), True)
    units[400] = (1 << 31) | 0
    b = 400 ^ ord("b")
    units[b] = unit(b ^ 300, ord("b"), True)
    units[300] = (1 << 31) | 2
    blob = np.array([4 * len(units)], "<u4").tobytes() + np.array(units, "<u4").tobytes() + b"X\0YZ\0"
    m = pieces.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"YZ") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"b", 0) is None


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_bpe_equals_library(texts):
    from tokenizers import Tokenizer

    path = tokens.default("word_bpe_49k.json")
    data, offsets = text.buffers(text.strings(pa.array(texts, pa.string())))
    ids, cuts = tokens.word_bpe(path).encode(data, *text.word_spans(data, offsets))
    lib = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_quality(spark, sf, documents):
    got = by_id(queries.op10_quality_rules(spark, sf))
    for i, t in documents:
        t = t or ""
        w = t.encode().split()
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        mark = [False] * len(w)
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                mark[k : k + 3] = [True] * 3
        r = got[i]
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (len(w), dup, sum(mark))
        assert (r.word_chars, r.n_symbols) == (sum(len(x.decode()) for x in w), sum(ch in "#*$%&|<>" for ch in t))
        assert r.base_failed == (len(w) < 50 or 100 * sum(mark) > 50 * len(w)) and r.kept <= (not r.base_failed)


def test_word_spans():
    data, offsets = text.buffers(text.strings(pa.array(["a  b"])))
    starts, ends, at = text.word_spans(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"a", b"b"] and at.tolist() == [0, 2]


@pytest.fixture(scope="module")
def mapped_model(tmp_path_factory):
    """The public model with the compiled character map that the library has for NFKC, nothing trained."""
    import public_tokenizers as P
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    def proto(raw):
        m = pb.ModelProto()
        m.ParseFromString(raw)
        return m

    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        m = proto(f.read())
    m.normalizer_spec.CopyFrom(proto(rules.serialized_model_proto()).normalizer_spec)
    path = tmp_path_factory.mktemp("model") / "nfkc.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@settings(max_examples=300, deadline=None)
@given(t=st.text(st.sampled_from("aB Ｈ①½ﬁ㌔ﾃｽﾄéä…™ ​\t\r\n　日🎉≪ﷺ"), max_size=20) | st.text(max_size=20))
def test_a_compiled_character_map_equals_the_library(mapped_model, t):
    m = pieces.model(mapped_model)
    assert len(m.map.units) > 10_000 and not m.splits
    made, source = m.normalise(t.encode("utf-8", "ignore"))
    t = t.encode("utf-8", "ignore").decode()
    want, offsets = m.lib.normalize(t, with_offsets=True)
    assert made.decode() == want
    # the source of each normalised character, in bytes
    at = np.cumsum([0, *(len(c.encode()) for c in t)])
    first = np.cumsum([0, *(len(c.encode()) for c in want)])
    assert [int(source[i]) for i in first[:-1]] == [int(at[o]) for o in offsets[: len(want)]]


def test_spans_under_a_compiled_character_map(spark, mapped_model):
    texts = ["Ｈｅｌｌｏ　ｗｏｒｌｄ ①②", "  ﬁne ﬂag ½ ", None, "日本語ﾃｽﾄ…", "plain words"]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), mapped_model).collect()
    lib = pieces.model(mapped_model).lib
    for r in rows:
        t = texts[r.doc_id] or ""
        p = r.pieces
        assert p.ids == [*lib.encode(t), lib.eos_id()] and p.decoded == lib.decode(p.ids)
        assert p.begin == sorted(p.begin) and p.end == sorted(p.end) and all(a <= b <= len(t.encode()) for a, b in zip(p.begin, p.end))
    (hello,) = [r.pieces for r in rows if r.doc_id == 0]
    raw = texts[0].encode()
    shown = [raw[a:b].decode() for a, b in zip(hello.begin, hello.end)]
    assert "".join(shown) == texts[0] and shown[0].startswith("Ｈ")


def plain_prints(t, k=16, w=32):
    """(hash, place) of each window's smallest k-gram hash, the rightmost of equal ones, with whole numbers and loops."""
    mask = 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) >> 24

    def polynomial(part):
        h = 0
        for c in part:
            h = (h * 0xD6E8FEB86659FD93 + ord(c)) & mask
        return h

    if not t:
        return []
    if len(t) < k:
        return [(mixed(polynomial(t) + len(t) & mask), 0)]
    hashes = [mixed(polynomial(t[i : i + k])) for i in range(len(t) - k + 1)]
    found = []
    for i in range(max(1, len(hashes) - w + 1)):
        part = range(i, min(i + w, len(hashes)))
        place = min(part, key=lambda j: (hashes[j], -j))
        if not found or found[-1][1] != place:
            found.append((hashes[place], place))
    return found


def test_fingerprint_query_equals_plain_loops(spark, sf, documents):
    got = by_id(queries.op4_document_fingerprints(spark, sf))
    order = sorted(((i, t or "") for i, t in documents), reverse=True)
    short = [k for k, (_, t) in enumerate(order) if len(t) < 4000]
    for k in short[:60]:
        (i, t), (_, after) = order[k], order[(k + 1) % len(order)]
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        prints, again = plain_prints(t), plain_prints(changed)
        r = got[i]
        assert r.fingerprint == ",".join(f"{h:010x}" for h, _ in prints) and r.positions == ",".join(str(x) for _, x in prints)
        assert r.edited_fingerprint == ",".join(f"{h:010x}" for h, _ in again) and r.n_prints == len(prints)
        a, b = {h for h, _ in prints}, {h for h, _ in again}
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
