"""Periodic runs against direct comparison of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import periodic, queries


def brute(words):
    """All (start, length, period), by extending every place of every period word by word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def collapsed(words, runs):
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[:-1] for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    assert sum(v[1] > 0 for v in got.values()) > 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90) | st.lists(st.sampled_from("abcde"), max_size=30).flatmap(lambda x: st.integers(1, 6).map(lambda k: x * k)), max_size=5))
def test_runs_of_small_alphabets(texts):
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([ord(c) for t in texts for c in t], dtype=np.int64)
    got = periodic.find_runs(codes, at)
    assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute(t)]


def test_parts_and_failed_hashes_change_nothing(monkeypatch):
    rng = random.Random(3)
    words = [rng.randrange(3) for _ in range(400)] + [7] * 200 + list(range(50)) * 5
    codes, at = np.array(words, dtype=np.int64), np.array([0, 300, 300, len(words)])
    whole = periodic.find_runs(codes, at).tolist()
    assert [r[1:] for r in whole if r[0] == 2] == [list(r) for r in brute(words[300:])]
    monkeypatch.setattr(periodic, "PAIRS", 50)
    assert periodic.find_runs(codes, at).tolist() == whole
    # a hash that takes every word for the same finds too much; the verification sends those texts to the direct search
    monkeypatch.setattr(periodic._Prefixes, "same", lambda self, a, p, n: np.ones(len(a), dtype=bool))
    assert periodic.find_runs(codes, at).tolist() == whole


def test_thue_morse_words_are_told_apart():
    """A sequence that confuses polynomial hashes modulo a power of two."""
    word = [bin(k).count("1") % 2 for k in range(4096)]
    codes = np.array(word * 2 + [1 - x for x in word], dtype=np.int64)
    assert periodic.find_runs(codes, np.array([0, len(codes)])).tolist() == [[0, *r] for r in brute(codes.tolist())]


def test_long_repeats_stay_quick_and_awkward_rows(spark):
    rows = [(1, "w " * 60_000), (2, None), (None, ""), (2, " \n"), (3, "a b " * 5 + "a"), (3, "a b " * 5 + "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 periodic", "2 runs")
    got = periodic.collapse(df).collect()
    assert len(got) == 6 and all(r["runs"] == 2 for r in got)
    by = {(r.doc_id, r.text): r.periodic for r in got}
    assert by[1, "w " * 60_000].runs == [(0, 60_000, 1)] and by[1, "w " * 60_000].collapsed == "w"
    for key in ((2, None), (None, ""), (2, " \n")):
        assert (by[key].n_words, by[key].runs, by[key].best, by[key].collapsed) == (0, [], None, "")
    assert by[3, "a b " * 5 + "a"].collapsed == "a b" and by[3, "a b " * 5 + "a"].best == (0, 11, 2)
    assert periodic.collapse(df.limit(0)).count() == 0
