"""Fertility values and verdicts of the quality rules against the libraries, text by text, and scripts that the tables lack."""

import base64
import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import quality, queries, tokens

#: The first article of the Universal Declaration of Human Rights and a line like it.
SCRIPTS = {
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "han": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "ascii": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "latin": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
}


@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers
    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=tokens.default("piece_bpe_32k.model"))
    with open(tokens.default("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return piece, tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def entropy(ids):
    n = len(ids)
    return -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0


def whole(token):
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def plain_fertility(text, vocabularies):
    """The values of a text, word by word with the libraries."""
    piece, many = vocabularies
    words = [w.decode() for w in text.encode().split()]
    ids = [i for w in words for i in piece.encode(w)]
    shown = {i: piece.id_to_piece(i).replace("▁", "") for i in set(ids)}
    spells = [i for i in ids if piece.is_byte(i) or any(c.isalnum() or unicodedata.category(c)[0] == "M" for c in shown[i])]
    symbols = [i for i in ids if i not in set(spells) and shown[i]]
    # a byte piece counts as a character where it begins one
    spelled = sum(not 0x80 <= int(shown[i][3:5], 16) < 0xC0 if piece.is_byte(i) else len(shown[i]) for i in spells)
    other = [i for w in words for i in many.encode_ordinary(" " + w)]
    n, m, chars = len(ids), len(other), sum(map(len, words))
    return {
        "n_tokens": n, "chars_per_token": chars / n if n else 0.0, "byte_share": sum(map(piece.is_byte, ids)) / n if n else 0.0, "token_entropy": entropy(ids),
        "symbol_share": len(symbols) / n if n else 0.0, "chars_per_word_token": spelled / max(1, len(spells)), "many_chars_per_token": chars / m if m else 0.0,
        "many_byte_share": sum(not whole(many.decode_single_token_bytes(i)) for i in other) / m if m else 0.0, "many_entropy": entropy(other),
    }


def test_fertility_and_verdict_of_every_document(spark, sf, vocabularies):
    texts = {r.doc_id: (r.text or "", r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, (text, lang) in texts.items():
        want, r = plain_fertility(text, vocabularies), got[i]
        assert {k: r[k] for k in want} == pytest.approx(want)
        assert r.script == ("latin" if any(0xC0 <= ord(c) < 0x250 for c in text) else "ascii")
        band = quality.LANGUAGES[lang]
        least = max(b for n, b in band.low_entropy if want["n_tokens"] >= n)
        good = band.low_chars <= want["chars_per_word_token"] <= 8 and want["byte_share"] <= 0.25 and want["symbol_share"] <= band.high_symbols and want["token_entropy"] >= least
        good = good and band.many_low <= want["many_chars_per_token"] <= 9 and want["many_byte_share"] <= 0.25
        assert r.kept == (not r.base_failed and good)
    assert sum(not r.kept and not r.base_failed for r in got.values()) > 0


def test_scripts_and_their_bands(spark, vocabularies):
    rules = quality.Rules(least_words=1, high_repeat=1.0)
    rows = [(name, text, lang) for name, text in SCRIPTS.items() for lang in (None, "en")]
    docs = spark.createDataFrame(rows, "name string, text string, lang string")
    for r in quality.measure(docs, rules).collect():
        want = plain_fertility(r.text, vocabularies)
        assert r.quality.script == r.name and {k: r.quality[k] for k in want} == pytest.approx(want)
        if r.name not in ("ascii", "latin"):  # so short a text of these has too little entropy only from 150 tokens on
            assert r.quality.kept, (r.name, want)
    # random letters of a script leave no band of prose: words without any vowel signs fall to bytes and single letters
    rng = np.random.default_rng(3)
    noise = " ".join("".join(chr(rng.integers(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(60))
    dump = " ".join("%08x" % rng.integers(0, 2**32) for _ in range(200))
    marks = " ".join("#*$%&"[k % 5] * 3 for k in range(100))
    got = [r.quality.kept for r in quality.measure(spark.createDataFrame([(1, noise, "zh"), (2, dump, None), (3, marks, None)], "name int, text string, lang string"), rules).orderBy("name").collect()]
    assert got == [False, False, False]


@pytest.mark.parametrize("text, want", [("", "none"), ("12 34", "none"), ("abc", "ascii"), ("abc é", "latin"), ("да abc да", "cyrillic"), ("漢字かな", "kana"), ("漢字", "han"), ("é ñ", "latin")])
def test_script_of_a_text(text, want):
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    assert quality.script(quality._scripts(data, offsets)[0]) == want
    array = pa.array([text])
    assert array[0].as_py() == text
