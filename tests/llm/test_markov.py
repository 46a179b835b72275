"""The hidden Markov model against plain recursions in logarithms, counts, and held-out documents."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import markov, queries


def words(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def is_held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def unigram(docs):
    """Per document: tokens, known ones, training tokens and the smoothed unigram's score; and the counts."""
    count = Counter(t for i, x in docs if not is_held(i) for t in (*words(x), None))
    total, distinct = sum(count.values()), len(count)
    out = []
    for i, x in docs:
        own = [*words(x), None]
        out.append((i, len(own), sum(count[t] > 0 for t in own), total, sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in own)))
    return out, count


def forward(model, symbols):
    """log10 of the probability, by a recursion in logarithms without scales."""
    with np.errstate(divide="ignore"):
        start, step, emit = np.log(model.start), np.log(model.step), np.log(model.emit)
    x = start + emit[symbols[0]]
    for s in symbols[1:]:
        y = x[:, None] + step
        top = y.max(0)
        x = top + np.log(np.exp(y - top).sum(0)) + emit[s]
    return (x.max() + math.log(np.exp(x - x.max()).sum())) / math.log(10)


def word_share(lex, count, word, rank, shape):
    if rank < lex.own:
        return 0.0
    c = count[word]
    return math.log10((c - lex.discount if c else lex.discount * lex.shape_types[shape] + 1) / (lex.shape_tokens[shape] + 1))


def scores(docs, model, lex, count, n_shapes):
    rank = {w: k for k, w in enumerate(lex.words.to_pylist())}
    out = []
    for _, text in docs:
        symbols, within = [], 0.0
        for w in words(text):
            b = np.frombuffer(w.encode(), np.uint8)
            shape = int(markov.shapes(b, np.array([0]), np.array([len(b)]), n_shapes)[0])
            r = rank.get(w, 10**9)
            symbols.append(1 + r if r < lex.own else 1 + lex.own + shape)
            within += word_share(lex, count, w, r, shape)
        out.append(forward(model, [*symbols, markov.END]) + within)
    return out


@pytest.fixture
def seen(monkeypatch):
    """What the operator counted and trained."""
    kept = {}
    lexicon, train = markov.lexicon, markov.train
    monkeypatch.setattr(markov, "lexicon", lambda *a: kept.setdefault("lex", lexicon(*a)))
    monkeypatch.setattr(markov, "train", lambda *a: kept.setdefault("model", train(*a)))
    return kept


def test_query_equals_plain_recursions(spark, sf, seen):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op11_hmm_scoring(spark, sf).collect()}
    base, count = unigram(docs)
    model, lex = seen["model"], seen["lex"][0]
    assert len(got) == len(docs)
    for (i, n, known, total, score), wanted in zip(base, scores(docs, model, lex, count, markov.Params().shapes)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(i), n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9) and r.score == pytest.approx(wanted, rel=1e-9)
    held = [got[i] for i, _ in docs if is_held(i)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


ROWS = [(1, "the cat sat " * 30), (2, None), (None, "The CAT"), (None, None), (3, ""), (3, ""), (4, "unheard words É é"), (5, "the cat sat on " * 20), (6, " \n\t"), (16, "the dog zzz zzz yyy the"), (11, "the dog xyzzy xyzzy xyzzy"), (19, "xyzzy Xyzzy cat")]


@pytest.mark.parametrize("known", [200_000, 2, 0])
def test_awkward_rows_with_and_without_the_join(spark, seen, known):
    """Words beyond the table that tasks hold come from a join; scores are the same function of the counts."""
    p = markov.Params(states=3, own=2, shapes=5, words=known, rounds=3, stretch=7)
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "1 score", "2 word", "3 n", "4 symbols", "5 held__2").repartition(3)
    got = sorted(([r.doc_id, r.text, *r.score] for r in markov.score(df, p).collect()), key=repr)
    base, count = unigram(ROWS)
    wanted = scores(ROWS, seen["model"], seen["lex"][0], count, p.shapes)
    assert any(is_held(i) for i, _ in ROWS) and seen["lex"][0].whole == (known > 2)
    for g, w in zip(got, sorted(([i, x, n, k, t, b, s] for (i, n, k, t, b), (_, x), s in zip(base, ROWS, wanted)), key=repr)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert markov.score(df.filter("doc_id = 99"), p).count() == 0


def test_no_training_documents(spark):
    held = next(i for i in range(100) if is_held(i))
    (r,) = markov.score(spark.createDataFrame([(held, "a b")], "doc_id int, text string"), markov.Params(states=2, rounds=1)).collect()
    assert r.score[:4] == (3, 0, 0, 0.0) and np.isfinite(r.score.score)


def test_expected_counts_and_growing_likelihood():
    """Expected counts equal those from all paths' posteriors, sequence by sequence; rounds never lose likelihood but for the prior."""
    rng = np.random.default_rng(5)
    p = markov.Params(states=3, prior=1e-9)
    blobs = [rng.integers(0, 6, size=n, dtype=np.int32).tobytes() for n in (9, 1, 4, 4, 30)]
    counts = np.bincount(np.frombuffer(b"".join(blobs), np.int32), minlength=6).astype(float)
    model = markov.first_model(counts, p)
    got = markov.expected(model, *markov._stretches(blobs, 10))
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for b in blobs:
        whole = np.frombuffer(b, np.int32)
        for low in range(0, len(whole), 10):
            s = whole[low : low + 10]
            f, g = np.zeros((len(s), 3)), np.ones((len(s), 3))
            f[0] = model.start * model.emit[s[0]]
            for t in range(1, len(s)):
                f[t] = f[t - 1] @ model.step * model.emit[s[t]]
            for t in range(len(s) - 2, -1, -1):
                g[t] = model.step @ (model.emit[s[t + 1]] * g[t + 1])
            like = f[-1].sum()
            start += f[0] * g[0] / like
            for t in range(len(s)):
                emit[s[t]] += f[t] * g[t] / like
                if t:
                    step += f[t - 1][:, None] * model.step * (model.emit[s[t]] * g[t])[None] / like
    for x, y in zip(got[:3], (start, step, emit)):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-4)
    before = -np.inf
    for _ in range(6):
        run, _ = markov._expected_rows(type("T", (), {"value": model}), 2**40, 3)
        likelihood = markov.likelihoods(model, blobs).sum()
        assert likelihood > before - 0.05
        before = likelihood
        batch = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["symbols"])
        model = markov._maximised(pa.Table.from_batches(list(run([batch]))), np.full(6, 1 / 6), p)


def test_probabilities_of_words_sum_to_one(spark):
    """All known words and one unseen word for each shape have the whole of each shape."""
    docs = spark.createDataFrame([(k, "a b c dd dd eee ffff " * (k % 3) + f"w{k}") for k in range(40)], "doc_id int, text string")
    p = markov.Params(shapes=4, own=3)
    counts = markov.word_counts(docs, "text", p.shapes)
    lex, total, distinct = markov.lexicon(counts, 40, p)
    rows = counts.collect()
    assert (total, distinct) == (sum(r.n for r in rows) + 40, len(rows) + 1)
    for shape in range(4):
        own = {w.as_py() for w in lex.words[: lex.own]}
        seen = sum((r.n - lex.discount) for r in rows if r["shape"] == shape and r.word not in own)
        unseen = lex.discount * lex.shape_types[shape] + 1
        assert (seen + unseen) / (lex.shape_tokens[shape] + 1) == pytest.approx(1)
