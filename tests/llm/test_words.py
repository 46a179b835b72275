"""Words of the word-end vocabulary, encoded all at once."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa

from starloom.llm import text, tokens


def _table():
    return tokens.word_bpe(tokens.default("word_bpe_49k.json"))


def test_every_token_is_the_only_way_to_spell_itself():
    """What lets lowest ids of neighbours stand for the merges: merges before a token's own leave the two parts it is made of."""
    model = _table().model
    parts = {}
    for token, rank in model.ranks.items():
        if rank >= 512:
            word = [token[k : k + 1] for k in range(len(token))]
            if word[-1] == b" ":
                word[-2:] = [word[-2] + b" "]
            while len(word) > 2:
                best = min(range(len(word) - 1), key=lambda k: model.ranks.get(word[k] + word[k + 1], rank))
                assert model.ranks.get(word[best] + word[best + 1], rank) < rank, token
                word[best : best + 2] = [word[best] + word[best + 1]]
            parts[rank] = word
    with open(tokens.default("word_bpe_49k.json"), "rb") as f:
        stated = json.load(f)["model"]
    spelled = {i: t for t, i in model.ranks.items()}
    for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in stated["merges"]):
        assert parts[512 + k] == [spelled[stated["vocab"][a]], spelled[stated["vocab"][b]]]


def test_distinct_words_go_to_the_quicker_library_at_once(monkeypatch):
    """Before, each new word was a call of the library's model; now only words that are not plain Latin are one of the library."""
    table, r = _table(), random.Random(3)
    words = ["".join(r.choice("abcdefghxyzABCÉéßöÿÀ'0123456789!?.,<|>_-/") for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    words += ["<|endoftext|>", "日本語", "éa", "İx", "\x00", "it'sx", "don't", "a<|b"]
    data, offsets = text.buffers(text.strings(pa.array([" ".join(words[:9_000]), "", None, "\n\t ".join(words[9_000:])])))
    blobs = table.model(words)
    monkeypatch.setattr(type(table.model), "__call__", lambda *_: 1 / 0)
    ids, cuts = table.encode(data, *text.word_spans(data, offsets))
    assert ids.tobytes() == b"".join(blobs)
    assert cuts.tolist() == [0, *[sum(map(len, blobs[:9_000])) // 4] * 3, len(ids)]


def test_vocabulary_whose_ids_do_not_follow_the_merges_uses_its_own_model():
    model = _table().model
    words = pa.array(["weather", "it's", "42", "日"], pa.large_string())
    quick, (ids, sizes) = model.quick, model.many(words)
    try:
        model.quick = None
        other, n = model.many(words)
    finally:
        model.quick = quick
    assert np.array_equal(ids, other) and np.array_equal(sizes, n)
