"""A hidden Markov language model of words, trained by Baum-Welch over all training documents.

Tokens are words in lower case (A-Z alone) and one end for each document. Latent states emit symbols: the end, each of the most
frequent words by itself, and a shape (length and last bytes, hashed) for every other word; a shape then emits the word by its count in training,
less an absolute discount that goes to the shape's unseen word. So every count of the corpus enters, and the probabilities of all known words
and one unseen word sum to one.

Spark counts words by partial sums. The most frequent WORDS words go to all tasks, a bounded table; the others of a document, seldom by
construction, are joined with the counts by hot key. Documents become arrays of symbols, written once. In each round every task runs the
scaled forward and backward recursions over stretches of its documents, many at a time, and sends expected counts by symbol, which Spark
adds up; the driver holds the model alone, whose size is a parameter. Scores are exact: the scaled forward recursion over each whole text.

Training takes each text in stretches of at most `stretch` tokens, each beginning with its own start, so that memory is bounded; every token
of every training text counts. Defined results: null and empty texts are an end alone; a null id counts as an empty one; repeated rows are documents of
their own; without training documents all words are unseen and states emit their prior. Input columns named as the output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from starloom.llm.frames import add_struct
from starloom.llm.shared import joined_by_hot_key, written
from starloom.llm.text import LOWER, buffers, mix, packed_words, ragged, slices, strings, word_spans

#: The symbol of the end; own words follow, then shapes.
END = 0


@dataclass(frozen=True)
class Params:
    """`own` words of `least` occurrences or more have a symbol of their own, others one of `shapes`; `words` of the most frequent ones are sent to
    all tasks. `rounds` of training; `prior` tokens of the unigram distribution smooth each state's emissions."""

    states: int = 16
    own: int = 16_384
    least: int = 3
    shapes: int = 1024
    words: int = 200_000
    rounds: int = 6
    stretch: int = 256
    prior: float = 20.0
    seed: int = 11


@dataclass(frozen=True)
class Lexicon:
    """What tasks know of the counts: the most frequent words, by falling count, and sums by shape of the words without own symbol."""

    words: pa.Array
    counts: np.ndarray
    own: int
    shape_tokens: np.ndarray
    shape_types: np.ndarray
    discount: float
    ends: int
    whole: bool

    def symbol(self, rank: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """rank is that of the word in the list, -1 if it is not there."""
        return np.where((rank >= 0) & (rank < self.own), rank + 1, 1 + self.own + shape)

    def within(self, rank: np.ndarray, shape: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of the word's share of its symbol."""
        seen = np.where(count > 0, count - self.discount, self.discount * self.shape_types[shape] + 1)
        return np.where((rank >= 0) & (rank < self.own), 0.0, np.log10(seen / (self.shape_tokens[shape] + 1)))


@dataclass(frozen=True)
class Model:
    """Start and transition probabilities, and those of each symbol (rows) by state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each word, from its length class and last three bytes."""
    size = ends - starts
    key = np.minimum(size, 12) // 3
    for k in (1, 2, 3):
        key = key * 256 + np.where(size >= k, data[np.maximum(ends - k, 0)], 0)
    return (mix(key.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _distinct(texts: pa.Array, n_shapes: int):
    """Distinct lower-cased words with their shapes, each word's number, and the words before each text."""
    data, offsets = buffers(texts)
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets)
    coded = packed_words(data, starts, ends).dictionary_encode()
    words = coded.dictionary.cast(pa.large_string())
    flat, places = buffers(words)
    return words, shapes(flat, places[:-1], places[1:], n_shapes), np.asarray(coded.indices, dtype=np.int64), at


_COUNTS = StructType([StructField("word", StringType()), StructField("shape", IntegerType()), StructField("n", LongType())])


def word_counts(docs: DataFrame, text_col: str, n_shapes: int) -> DataFrame:
    """(word, shape, n) over all rows of docs."""

    def run(batches):
        for b in slices(batches, text_col):
            words, shape, code, _ = _distinct(strings(b.column(text_col)), n_shapes)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(shape, pa.int32()), pa.array(np.bincount(code, minlength=len(words)), pa.int64())], _COUNTS.names)

    return docs.select(text_col).mapInArrow(run, _COUNTS).groupBy("word", "shape").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, ends: int, params: Params) -> tuple[Lexicon, int, int]:
    """The table for tasks, and the numbers of all and of distinct training tokens; `ends` is the number of training documents."""
    # counts in narrow classes say from which on there are no more than so many words; nothing is sorted but those
    of_class = F.floor(F.log2("n") * 64)
    sizes = sorted(((r["class"], r["words"]) for r in counts.groupBy(of_class.alias("class")).agg(F.count("*").alias("words")).collect()), reverse=True)
    held = np.cumsum([w for _, w in sizes]) <= params.words
    least = min((c for (c, _), h in zip(sizes, held) if h), default=2**31)
    top = counts.filter(of_class >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    n = np.asarray(top["n"], dtype=np.int64)
    own = min(params.own, int(np.searchsorted(-n, -params.least, side="right")))
    sums = counts.groupBy("shape").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).collect()
    tokens, types = np.zeros(params.shapes), np.zeros(params.shapes)
    for r in sums:
        tokens[r["shape"]], types[r["shape"]] = r["tokens"], r["types"]
    total, distinct = int(tokens.sum()) + ends, int(types.sum()) + (ends > 0)
    shape = np.asarray(top["shape"], dtype=np.int64)[:own]
    np.subtract.at(tokens, shape, n[:own])
    np.subtract.at(types, shape, 1)
    once, twice = sum(r["once"] for r in sums), sum(r["twice"] for r in sums)
    words = top["word"].combine_chunks().cast(pa.large_string())
    return Lexicon(words, n, own, tokens, types, (once + 0.5) / (once + 2 * twice + 1), ends, len(n) == int(distinct - (ends > 0))), total, distinct


RARE = StructType([StructField("word", StringType()), StructField("shape", IntegerType())])
_ENCODED = StructType([
    StructField("symbols", BinaryType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()),
    StructField("log_counts", DoubleType()), StructField("log_within", DoubleType()), StructField("rare", ArrayType(RARE)),
])


def _encoded(table, text: str, n_shapes: int):
    def compute(batch: pa.RecordBatch) -> list:
        lex: Lexicon = table.value
        words, shape, code, at = _distinct(strings(batch.column(text)), n_shapes)
        rank = pc.fill_null(pc.index_in(words, value_set=lex.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        listed = rank >= 0
        count = np.where(listed, lex.counts[rank], 0) if len(lex.counts) else np.zeros(len(rank), dtype=np.int64)
        settled = listed | lex.whole
        symbol = lex.symbol(rank, shape)[code]
        n = np.diff(at)
        text_of = np.repeat(np.arange(len(n)), n)
        summed = lambda x: np.bincount(text_of, weights=x[code], minlength=len(n))
        flat = np.empty(len(code) + len(n), dtype=np.int32)
        place = np.arange(len(code)) + text_of
        flat[place] = symbol
        flat[at[1:] + np.arange(len(n))] = END
        bounds = (at + np.arange(len(at))) * 4
        rare = ~settled[code]
        upto = np.concatenate([[0], np.cumsum(rare)])[at]
        which = pa.array(code[rare])
        rest = pa.StructArray.from_arrays([words.take(which).cast(pa.string()), pa.array(shape, pa.int32()).take(which)], RARE.names)
        return [
            pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).cast(pa.binary()),
            n + 1,
            summed(settled & (count > 0)).astype(np.int64) + (lex.ends > 0),
            summed(np.where(settled, np.log10(count + 1.0), 0)) + np.log10(lex.ends + 1.0),
            summed(np.where(settled, lex.within(rank, shape, count), 0)),
            pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), rest),
        ]

    return compute


def first_model(symbol_counts: np.ndarray, params: Params) -> Model:
    """A seeded beginning: the symbols' shares, disturbed by state, and states that like to stay."""
    rng = np.random.default_rng(params.seed)
    k = params.states
    share = (symbol_counts + 1) / (symbol_counts.sum() + len(symbol_counts))
    emit = share[:, None] * rng.gamma(2.0, 0.5, size=(len(share), k))
    step = rng.gamma(1.0, size=(k, k)) / k + 2 * np.eye(k)
    return Model(np.full(k, 1 / k), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _stretches(blobs: list[bytes], stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, and start and length of each stretch, longest first."""
    flat = np.frombuffer(b"".join(blobs), np.int32).astype(np.int64)
    n = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
    parts = -(-n // stretch)
    first = np.repeat(np.cumsum(n) - n, parts)
    k = ragged(np.zeros(len(n), dtype=np.int64), parts) * stretch
    size = np.minimum(stretch, np.repeat(n, parts) - k)
    order = np.argsort(-size, kind="stable")
    return flat, (first + k)[order], size[order]


def expected(model: Model, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions (symbol by state), and the log10 likelihood, of sequences that are sorted by falling length:
    one scaled forward and one backward recursion for all of them at once."""
    start, step, emit = (x.astype(np.float32) for x in (model.start, model.step, model.emit))
    k = len(start)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    place = np.concatenate([[0], np.cumsum(active)])
    alpha = np.empty((place[-1], k), dtype=np.float32)
    scale = np.empty((place[-1], 1), dtype=np.float32)
    symbols = np.empty(place[-1], dtype=np.int64)
    for t, n in enumerate(active):
        a, b = place[t], place[t + 1]
        symbols[a:b] = flat[starts[:n] + t]
        x = emit[symbols[a:b]]
        x *= start if t == 0 else alpha[place[t - 1] : place[t - 1] + n] @ step
        np.maximum(x.sum(1, keepdims=True), np.float32(1e-30), out=scale[a:b])
        np.divide(x, scale[a:b], out=alpha[a:b])
    moved = np.zeros((k, k))
    beta = np.ones((active[-1], k), dtype=np.float32)
    for t in range(len(active) - 1, 0, -1):
        a, b, before = place[t], place[t + 1], place[t - 1]
        n, m = active[t], active[t - 1]
        ahead = emit[symbols[a:b]] * beta
        ahead /= scale[a:b]
        moved += alpha[before : before + n].T @ ahead
        alpha[a:b] *= beta
        beta = np.concatenate([ahead @ step.T, np.ones((m - n, k), dtype=np.float32)]) if m > n else ahead @ step.T
    alpha[: active[0]] *= beta
    emitted = np.stack([np.bincount(symbols, weights=alpha[:, j], minlength=len(emit)) for j in range(k)], axis=1)
    return alpha[: active[0]].sum(0, dtype=np.float64), moved * model.step, emitted, float(np.log10(scale.astype(np.float64)).sum())


def _expected_rows(table, stretch: int, k: int):
    """Rows of expected counts: symbols from 0 on, steps from state j at -2 - j, starts at -1; `of` has a value by state."""
    names = ["symbol", *(f"s{j}" for j in range(k))]

    def run(batches):
        model: Model = table.value
        start, step, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
        for b in slices(batches, "symbols", 1_000_000):
            flat, starts, sizes = _stretches(b.column("symbols").to_pylist(), stretch)
            # a long text gives many stretches, so they are met in parts as well
            for low in range(0, len(starts), 2000):
                s, m, e, _ = expected(model, flat, starts[low : low + 2000], sizes[low : low + 2000])
                start += s
                step += m
                emitted += e
        used = np.flatnonzero(emitted.any(axis=1))
        if len(used):
            values = np.concatenate([start[None], step, emitted[used]])
            symbol = np.concatenate([[-1], -2 - np.arange(k), used])
            yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int32()), *(pa.array(np.ascontiguousarray(values[:, j])) for j in range(k))], names)

    return run, StructType([StructField("symbol", IntegerType()), *(StructField(n, DoubleType()) for n in names[1:])])


def _maximised(rows: pa.Table, share: np.ndarray, params: Params) -> Model:
    k = params.states
    symbol = np.asarray(rows["symbol"], dtype=np.int64)
    values = np.stack([np.asarray(rows[f"s{j}"]) for j in range(k)], axis=1)
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(share), k))
    start += values[symbol == -1].sum(0)
    step[-2 - symbol[symbol < -1]] = values[symbol < -1]
    emit[symbol[symbol >= 0]] = values[symbol >= 0]
    emit += params.prior * share[:, None]
    return Model((start + 0.1) / (start + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def train(sequences: DataFrame, symbol_counts: np.ndarray, params: Params) -> Model:
    """Rounds of expected counts over all rows of `sequences` (column symbols), added up by symbol; only the model comes to the driver."""
    sc = sequences.sparkSession.sparkContext
    model = first_model(symbol_counts, params)
    share = (symbol_counts + 1) / (symbol_counts.sum() + len(symbol_counts))
    for _ in range(params.rounds):
        table = sc.broadcast(model)
        run, schema = _expected_rows(table, params.stretch, params.states)
        sums = sequences.select("symbols").mapInArrow(run, schema).groupBy("symbol").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(params.states)))
        model = _maximised(sums.toArrow(), share, params)
        table.unpersist()
    return model


def likelihoods(model: Model, blobs: list[bytes]) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion over all of them at once."""
    flat, starts, sizes = _stretches(blobs, 2**62)
    order = np.argsort(-np.array([len(b) for b in blobs]), kind="stable")
    total, x, t, n = np.zeros(len(blobs)), None, 0, len(blobs)
    if not len(blobs):
        return total
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    product = np.ones(len(blobs))
    for t, n in enumerate(active.tolist()):
        x = model.emit[flat[starts[:n] + t]] * (model.start if t == 0 else x[:n] @ model.step)
        scale = x.sum(1)
        x /= scale[:, None]
        # scales are multiplied up and their logarithm taken now and then
        product[:n] *= scale
        if t % 8 == 7:
            total[:n] += np.log10(product[:n])
            product[:n] = 1
    total += np.log10(product)
    out = np.empty(len(blobs))
    out[order] = total
    return out


FIELDS = StructType([
    StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("train_tokens", LongType()),
    StructField("base_score", DoubleType()), StructField("score", DoubleType()),
])


def score(docs: DataFrame, params: Params = Params(), text_col: str = "text", id_col: str = "doc_id", out: str = "score", carry: list[str] | None = None) -> DataFrame:  # noqa: B008
    """The carried columns of docs and a struct `out`: tokens, those known from training, training tokens, the smoothed unigram's
    log10 probability, and the model's. Documents for which held_out(id_col) holds are not trained on."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != out.lower() and (carry is None or c in carry)]
    rows = docs.select(F.struct(*kept).alias("kept__"), F.col(text_col).alias("text__"), held_out(id_col).alias("held__"))
    known = rows.filter(~F.col("held__"))
    counts = written(word_counts(known, "text__", params.shapes), "words")
    lex, total, distinct = lexicon(counts, known.count(), params)
    table = spark.sparkContext.broadcast(lex)
    coded = add_struct(rows, "coded__", _ENCODED, _encoded(table, "text__", params.shapes), text="text__", carry=["kept__", "held__"])
    coded = written(coded.select("kept__", "held__", "coded__.*").withColumn("row__", F.monotonically_increasing_id()), "symbols")
    of_symbols = np.concatenate([[lex.ends], lex.counts[: lex.own], lex.shape_tokens])
    model = train(coded.filter(~F.col("held__")), of_symbols, params)
    final = spark.sparkContext.broadcast(model)
    plain = StructType([StructField("log_model", DoubleType())])
    scored = add_struct(coded.drop("rare"), "model__", plain, lambda b: [likelihoods(final.value, b.column("symbols").to_pylist())], text="symbols", carry=["kept__", "row__", "n_tokens", "n_known", "log_counts", "log_within"], limit=16_000_000)
    if not lex.whole:
        scored = scored.join(_rare(coded, counts, lex), F.col("row__") == F.col("of__"), "left")
    else:
        scored = scored.selectExpr("*", "0L known__", "0D counts__", "0D within__")
    extra = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = F.col("n_tokens")
    result = F.struct(
        n, (F.col("n_known") + extra("known__")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + extra("counts__") - n * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model__.log_model") + F.col("log_within") + extra("within__")).alias("score"),
    )
    return scored.select("kept__.*", result.alias(out))


def _rare(coded: DataFrame, counts: DataFrame, lex: Lexicon) -> DataFrame:
    """Sums by row over the words that tasks have no count of, from the table of all counts."""
    each = coded.select("row__", F.explode("rare").alias("rare__")).select("row__", F.col("rare__.word").alias("word__"), F.col("rare__.shape").alias("shape__"))
    found = joined_by_hot_key(each, "word__", counts.select("word", "n"), "word")
    sums = coded.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lex.shape_tokens, lex.shape_types))], "of_shape int, tokens double, types double")
    c = F.coalesce("n", F.lit(0))
    within = F.log10(F.when(c > 0, c - lex.discount).otherwise(F.col("types") * lex.discount + 1) / (F.col("tokens") + 1))
    return (
        found.join(F.broadcast(sums), F.col("shape__") == F.col("of_shape"))
        .groupBy(F.col("row__").alias("of__"))
        .agg(F.count(F.when(c > 0, 1)).alias("known__"), F.sum(F.log10(c + F.lit(1.0))).alias("counts__"), F.sum(within).alias("within__"))
    )
