"""Token alignment against the libraries and plain loops over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import alignment, queries, tokens

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(x): x for x in _SHOWN} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in _SHOWN)}


def a_bytes(i):
    return bytes(_BYTE[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(text):
    """(A ids, B ids, groups of ids, links) of a whole text."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((a_bytes, a), (b_bytes, b))):
        return [], [], [], []
    ends = lambda f, ids: np.cumsum([len(f(i)) for i in ids]).tolist()
    a_end, b_end = ends(a_bytes, a), ends(b_bytes, b)
    cuts = sorted(set(a_end) & set(b_end))
    groups, low = [], 0
    for c in cuts:
        groups.append(([i for i, e in zip(a, a_end) if low < e <= c], [i for i, e in zip(b, b_end) if low < e <= c]))
        low = c
    at = dict(zip(b_end, b))
    return a, b, groups, [(i, at[e]) for i, e in zip(a, a_end) if e in at]


def expected(docs):
    found = [(i, brute(t)) for i, t in docs]
    count = Counter(x for _, r in found for x in r[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, (a, b, groups, links) in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=repr)


ODD = ["a▁b", "x\x00y", "  lead", "trail  ", "a \n\n  b\tc\r\nd", " nbsp  x", "a \nb", "　全角　空白 と漢字", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll 12,345 — ünïcode 🎉🎉", "﻿bom", "é ​ zero", "\r", " ", "\n", "a\rb \r c"]


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_token_alignment(spark, sf).collect()), key=repr)
    assert got == expected(docs)
    assert any(r[5] < r[4] for r in got)


@pytest.mark.parametrize("most", [10**6, 3])
def test_awkward_rows(spark, most):
    """Null, empty and odd texts, texts that spell other bytes, repeated rows, clashing names; broadcast or not."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, None), (None, ""), (50, "same words " * 40), (50, "same words " * 40), (60, "x" * 300 + " tail")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 aligned", "2 link", "3 n")
    found = alignment.corpus_links(df, most_pairs=most, digests=True).collect()
    assert all((r.link, r.n) == (2, 3) for r in found)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(((r.doc_id, *(r.aligned[c] for c in names)) for r in found), key=repr) == expected(rows)
    assert alignment.corpus_links(df.limit(0), digests=True).count() == 0


def test_whole_lists_and_group_links(spark):
    rows = [(k, t) for k, t in enumerate([*ODD, "tokenizations differ here and there, unbelievably", None, ""])]
    got = {r.doc_id: r.aligned for r in alignment.align(spark.createDataFrame(rows, "doc_id int, text string"), link="groups").collect()}
    for k, t in rows:
        a, b, groups, _ = brute(t)
        r = got[k]
        assert (r.a_ids, r.b_ids) == (a, b)
        assert (r.a_ends, r.b_ends) == (np.cumsum([len(x) for x, _ in groups]).tolist(), np.cumsum([len(y) for _, y in groups]).tolist())
        assert r.links == [x * B.get_piece_size() + y for p, q in groups for x in p for y in q]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'st\n\t\r é漢1.,<|▁\x0b"), max_size=25), max_size=4))
def test_units_equal_whole_texts(texts):
    pair = tokens.held(alignment.Pair, (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), "ends"))
    code, at, units = pair.align(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        a, b, groups, _ = brute(t)
        own = code[at[k] : at[k + 1]]
        assert [i for c in own for i in units.a[units.a_at[c] : units.a_at[c + 1]]] == a
        assert [i for c in own for i in units.b[units.b_at[c] : units.b_at[c + 1]]] == b
        assert sum(np.diff(units.group_at)[own]) == len(groups)


@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_bits(x, y):
    one, two = (alignment.Bits.of(np.array(sorted(s), dtype=np.int64), 301) for s in (x, y))
    assert (one & two).select().tolist() == sorted(x & y)
    assert one.rank(np.arange(301)).tolist() == [sum(k <= p for k in x) for p in range(301)]
