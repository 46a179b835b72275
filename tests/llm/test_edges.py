"""Every operator on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import fingerprint, html, huffman, licenses, neardup, packing, pieces, quality, secrets, substring, tokens

PASSAGE = " ".join(f"w{i}" for i in range(50))
ROWS = [
    (1, PASSAGE, "en"), (1, PASSAGE, "en"), (2, "x " + PASSAGE + " y", None), (None, PASSAGE, "en"), (None, None, None), (3, "", "de"),
    (4, None, "fr"), (5, "   \n\t ", "en"), (6, "Ünï " * 60_000, "zz"), (7, "one", "en"), (8, "password: hunter22 AKIA" + "A" * 16, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    for name in ("a", "b", "id", "n", "part", "spans", "pieces", "quality", "substring", "prints", "main", "root", "label", "sequence_id", "length"):
        base = base.withColumn(name, F.lit(1))
    return base


OPERATORS = {
    "substring": lambda d: substring.remove_repeated(d),
    "licenses": lambda d: licenses.scan(d),
    "packing": lambda d: packing.pack(packing.pieces(d, with_ids=True)),
    "fingerprint": lambda d: fingerprint.fingerprints(d),
    "fingerprint_chain": lambda d: fingerprint.compare_with_next(d),
    "huffman": lambda d: huffman.round_trip(d),
    "html": lambda d: html.extract(d, html_col="text"),
    "neardup": lambda d: neardup.near_duplicates(d),
    "secrets": lambda d: secrets.scan(d),
    "pieces": lambda d: pieces.encode(d),
    "quality": lambda d: quality.measure(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, docs, name):
    rows = OPERATORS[name](docs).collect()
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.filter("doc_id = 99")).count() == 0


def test_substring_results(spark, docs):
    got = {(r.doc_id, (r.text or "")[:2]): r.substring for r in substring.remove_repeated(docs).collect()}
    assert got[1, "w0"].n_removed == 50 and got[2, "x "].kept == "x y" and got[None, "w0"].kept == ""
    assert got[7, "on"].n_words == 1 and got[4, ""].n_words == 0
    assert got[6, "Ün"].n_removed == 60_000


def test_duplicate_results(spark, docs):
    got = {(r.doc_id, r.n_shingles): r for r in neardup.near_duplicates(docs).collect()}
    assert got[1, 46].component_id == 1 and got[None, 46].component_id == 1 and not got[None, 46].kept
    assert got[2, 48].component_id == 1 and not got[2, 48].chosen
    assert got[3, 0].component_id == 3 and got[None, 0].kept
    left = neardup.without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8]


def test_quality_results(spark, docs):
    got = {r.doc_id: r.quality for r in quality.measure(docs.filter("doc_id in (4, 6, 7)")).collect()}
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[6].base_failed and got[6].n_repeat_words == 60_000


def test_quality_bands_reject_symbol_noise(spark, sf):
    """Prose passes; the same words with symbol runs, between bars or as random letters pass the base counts and fail the band."""
    rng = random.Random(5)
    prose = quality.measure(spark.read.parquet(f"{sf}/documents.parquet")).filter("not quality.base_failed and quality.n_symbols = 0").orderBy("doc_id").limit(60).collect()
    rows = []
    for d in prose:
        w = d.text.split()
        noise = " ".join("".join(rng.choice("bcdfgjkqvwxz") for _ in range(6)) for _ in w)
        for k, t in enumerate((d.text, " ".join(x + rng.choice("*#$%&") * 3 for x in w), " | ".join(w), noise)):
            rows += [(k, t, d.lang), (k, t, d.lang.upper() + "-XX"), (k, t, None)]
    got = [(r.doc_id, r.quality.kept) for r in quality.measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).filter("not quality.base_failed").collect()]
    assert len(got) > 500 and all(kept == (k == 0) for k, kept in got)


def test_quality_bands_differ_by_language():
    rules = quality.Rules()
    assert len({rules.band(x, "ascii") for x in ("en", "de", "fr", "es", "zz")}) == 5 and rules.band("EN_us", "ascii") == rules.band("en", "ascii")


def awkward(texts=True):
    """(doc_id, text) of ROWS, text as operators see it."""
    return [(i, t or "") for i, t, _ in ROWS] if texts else ROWS


def by_text(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows)


def test_license_values(spark, docs):
    got = licenses.scan(docs).collect()
    canon = {"": "", "   \n\t ": "", "one": "one", "Ünï " * 60_000: "ünï " * 59_999 + "ünï"}
    assert all(r.license_id is None and r.notices == [] for r in got)
    want = {(i, hashlib.sha256(canon[t].encode()).hexdigest()) for i, t in awkward() if t in canon}
    assert want <= {(r.doc_id, r.canonical_sha256) for r in got} and sum(r.doc_id == 1 for r in got) == 2


def test_packing_values(spark, docs):
    lib = Tokenizer.from_file(tokens.default("word_bpe_49k.json"))
    want, sequences = [], defaultdict(list)
    for i, t in awkward():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want += [(i or -1, k, a, tuple(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, tuple(r.ids)) for r in rows) == sorted(want)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all([0, *(sum(n for _, n in sorted(s)[: k + 1]) for k in range(len(s)))][:-1] == [o for o, _ in sorted(s)] for s in sequences.values())


def test_fingerprint_values(spark, docs):
    got = {(r.doc_id, (r.text or "")[:2]): r.prints for r in fingerprint.fingerprints(docs).collect()}
    assert got[1, "w0"] == got[None, "w0"] and got[3, ""] == got[4, ""] == got[None, ""] and got[3, ""] != got[7, "on"]
    chain = fingerprint.compare_with_next(docs).collect()
    assert by_text([r for r in chain if r.doc_id is not None], "doc_id", "n_chars") == sorted((i, len(t)) for i, t in awkward() if i is not None)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in chain)
    assert next(r for r in chain if r.doc_id == 3).fingerprint == next(r for r in chain if r.doc_id == 4).fingerprint


def test_huffman_values(spark, docs):
    lib = Tokenizer.from_file(tokens.default("word_bpe_49k.json"))
    got = huffman.round_trip(docs).collect()
    sizes = sorted((i if i is not None else -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, [*lib.encode(t, add_special_tokens=False).ids, 1]) for i, t in awkward()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sizes
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)


def test_html_values(spark, docs):
    got = {(r.doc_id, (r.text or "")[:2]): r.main for r in html.extract(docs, html_col="text").collect()}
    assert got[3, ""].text == got[4, ""].text == got[5, "  "].text == "" and got[7, "on"].text == "one"
    assert got[6, "Ün"].text == ("Ünï " * 60_000).strip() and got[6, "Ün"].n_chars == 239_999


def test_secret_values(spark, docs):
    got = {(r.doc_id, (r.text or "")[:2]): r.spans for r in secrets.scan(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[8, "pa"]] == [("assign", 0, 18), ("access", 19, 39)]
    assert all(v == [] for k, v in got.items() if k != (8, "pa")) and len(got) == 10


def test_piece_values(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokens.default("piece_bpe_32k.model"))
    got = pieces.encode(docs).collect()
    for r in got:
        t = r.text or ""
        assert r.pieces.ids == [*lib.encode(t), lib.eos_id()] and r.pieces.n_tokens == len(r.pieces.ids) and r.pieces.decoded == lib.decode(r.pieces.ids)
        assert r.pieces.end[-1] == len(t.encode())
    assert len(got) == len(ROWS)
