"""Alignment of two tokenisers' tokens by the bytes at which both end, and how often ids are linked in the corpus.

Tokeniser A is a byte-level one and reads a space before the text; tokeniser B marks words and adds that space itself. Both spell the same
bytes or the text has no tokens here. Texts are cut where neither tokeniser's tokens can reach across, so each distinct unit of a slice is
encoded and aligned once. There, packed bit sets mark the bytes where A's and B's tokens end; their AND holds the shared cuts; sums of
set bits rank each cut among A's and B's tokens, which gives the token ranges of each group; links expand from the ranges.

Two kinds of links: `ends` links the tokens that end together (one pair a group), `groups` every A token of a group with every B token.
A link is the pair of ids as one number, A's id times B's vocabulary size plus B's id. Links are counted over all documents by Spark;
the table of counts is joined by broadcast only up to MOST_PAIRS rows, and by hot key beyond.

Defined results: null and empty texts, and texts whose joined A or B bytes differ from space and text, have no tokens: counts of zero, empty
lists, an empty digest. Repeated rows are documents of their own, and their links count each time. Input columns named as outputs are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from starloom.llm import pieces, tokens
from starloom.llm.frames import add_struct
from starloom.llm.shared import joined_by_hot_key, written
from starloom.llm.text import buffers, packed_words, ragged, strings

#: Rows of the table of link counts that may be broadcast (16 bytes of content each).
MOST_PAIRS = 2_000_000
#: Units up to so many bytes are remembered, in two generations of at most CACHE.
LONGEST, CACHE = 64, 100_000
#: White space before which no token of either tokeniser reaches back, and the characters that send a text whole to both libraries:
#: other white space, B's space mark and NUL.
_CUT = np.zeros(256, dtype=bool)
_CUT[[9, 10, 11, 12, 32]] = True
_WHITE = _CUT.copy()
_WHITE[13] = True
_ODD = "[\\x00\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2581}\\x{3000}\\x{feff}]"
_U64 = np.uint64


class Bits:
    """A packed set of places, with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros((size // 64 + 1) * 64, dtype=np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view(_U64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """The number of set places up to and with this one."""
        word = place >> 6
        below = self.words[word] & (~_U64(0) >> (63 - (place & 63)).astype(_U64))
        return self.before[word] + np.bitwise_count(below)

    def select(self) -> np.ndarray:
        """All set places, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def shared_groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last byte of each group, and the numbers of A and B tokens up to its end; sizes are the bytes of the tokens of the same text."""
    total = int(a_sizes.sum())
    a, b = (Bits.of(np.cumsum(s) - 1, total) for s in (a_sizes, b_sizes))
    cuts = (a & b).select()
    return cuts, a.rank(cuts), b.rank(cuts)


class Aligned:
    """The tokens, groups and links of distinct units, one after another; `*_at` holds where each unit's begin (one more entry than units)."""

    def __init__(self, pair: Pair, data: np.ndarray, unit_at: np.ndarray, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
        self.valid = _spells(pair.a_bytes, a, a_at, data, unit_at) & _spells(pair.b_bytes, b, b_at, data, unit_at)
        for ok, name, ids, at in ((self.valid, "a", a, a_at), (self.valid, "b", b, b_at)):
            size = np.where(ok, np.diff(at), 0)
            setattr(self, name, ids[ragged(at[:-1], size)])
            setattr(self, name + "_at", np.concatenate([[0], np.cumsum(size)]))
        a, b = self.a, self.b
        cuts, a_end, b_end = shared_groups(pair.a_size[a], pair.b_size[b])
        self.group_at = np.searchsorted(a_end, self.a_at, side="right")
        self.groups = (a_end, b_end)
        na, nb = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        if pair.link == "groups":
            count = na * nb
            k, width = ragged(np.zeros(len(count), dtype=np.int64), count), np.repeat(nb, count)
            self.links = a[np.repeat(a_end - na, count) + k // width] * pair.base + b[np.repeat(b_end - nb, count) + k % width]
        else:
            count = np.ones(len(a_end), dtype=np.int64)
            self.links = a[a_end - 1] * pair.base + b[b_end - 1]
        self.link_at = np.concatenate([[0], np.cumsum(count)])[self.group_at]

    def ends(self, which: int) -> np.ndarray:
        """A or B tokens of the unit up to the end of each group."""
        return self.groups[which] - np.repeat((self.a_at, self.b_at)[which][:-1], np.diff(self.group_at))

    def shown(self, pair: Pair) -> pa.Array:
        """Each unit's groups as "a1,a2|b1;"."""
        (a_end, b_end), a, b = self.groups, self.a, self.b
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_end - 1], b_last[b_end - 1] = 1, 1
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], b_end])[np.cumsum(a_last) - a_last]] = a + len(pair.a_size) * a_last
        order[np.arange(len(b)) + a_end[np.cumsum(b_last) - b_last]] = 2 * len(pair.a_size) + b + pair.base * b_last
        text = pair.shown.take(pa.array(order))
        at = np.frombuffer(text.buffers()[1], np.int64)[self.a_at + self.b_at]
        return pa.Array.from_buffers(pa.large_binary(), len(self.valid), [None, pa.py_buffer(at), text.buffers()[2]])


def _spells(table: pa.Array, ids: np.ndarray, at: np.ndarray, data: np.ndarray, unit_at: np.ndarray) -> np.ndarray:
    """Which units' tokens, joined, are the unit's bytes."""
    said = table.take(pa.array(ids))
    place = np.frombuffer(said.buffers()[1], np.int64)[at]
    ok = np.diff(place) == np.diff(unit_at)
    size = np.where(ok, np.diff(place), 0)
    body = np.frombuffer(said.buffers()[2], np.uint8) if said.buffers()[2] is not None else np.zeros(0, np.uint8)
    other = np.flatnonzero(body[ragged(place[:-1], size)] != data[ragged(unit_at[:-1], size)])
    ok[np.searchsorted(np.cumsum(size), other, side="right")] = False
    return ok


class Pair:
    """Two tokenisers and the ids of recent units."""

    def __init__(self, paths: tuple[str, str, str]):
        a_path, b_path, self.link = paths
        self.encode_a, spelled = _byte_level(a_path)
        self.b = pieces.Model(b_path)
        self.base = self.b.lib.get_piece_size()
        own = self.b.lib
        shown = [
            b"" if own.is_control(i) or own.is_unknown(i) else bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.base)
        ]
        self.a_bytes, self.b_bytes = pa.array(spelled, pa.large_binary()), pa.array(shown, pa.large_binary())
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (spelled, shown))
        # "id," and "id|" of A's ids, then "id," and "id;" of B's
        self.shown = pa.array([b"%d%c" % (i, end) for n, ends in ((len(spelled), b",|"), (self.base, b",;")) for end in ends for i in range(n)], pa.large_binary())
        self.young, self.old = {}, {}

    def _encoded(self, units: list[str], whole: bool = False) -> list[tuple[bytes, bytes]]:
        lib = self.b.lib
        other = lib.encode([u[1:] for u in units], num_threads=1) if whole else [x[self.b.lead :] for x in lib.encode(["\n" + u for u in units], num_threads=1)]
        return [(array("i", self.encode_a(u)).tobytes(), array("i", y).tobytes()) for u, y in zip(units, other)]

    def lookup(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """A's and B's ids, as int32 bytes, of units where no token of either reaches across their ends."""
        if len(self.young) + len(units) > CACHE:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = [young.get(u) or old.get(u) for u in units]
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            for k, x in zip(new, self._encoded([units[k] for k in new])):
                found[k] = x
        young.update((u, x) for u, x in zip(units, found) if len(u) <= LONGEST)
        return found

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Aligned]:
        """Unit numbers of all texts that have tokens, where each text's begin, and the units."""
        data, offsets = buffers(texts)
        size = np.diff(offsets)
        padded = np.insert(data, offsets[:-1][size > 0], 32)
        bounds = offsets + np.concatenate([[0], np.cumsum(size > 0)])
        white = _WHITE[padded]
        cut = np.zeros(len(padded) + 1, dtype=bool)
        cut[1:-1] = _CUT[padded[1:]] & ~white[:-1]
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _ODD))) if self.b.splits else np.flatnonzero(size > 0)
        for t in odd:
            cut[bounds[t] : bounds[t + 1]] = False
        cut[bounds] = True
        edge = np.flatnonzero(cut)
        starts, ends = edge[:-1], edge[1:]
        at = np.searchsorted(starts, bounds)
        # texts that go whole are the last units
        whole = np.zeros(len(starts), dtype=bool)
        whole[at[odd]] = True
        coded = packed_words(padded, starts[~whole], ends[~whole]).dictionary_encode()
        units = coded.dictionary.cast(pa.large_string()).to_pylist()
        code = np.empty(len(starts), dtype=np.int64)
        code[~whole] = np.asarray(coded.indices)
        code[whole] = len(units) + np.arange(len(odd))
        wholes = packed_words(padded, starts[whole], ends[whole])
        ids = self.lookup(units) + self._encoded(wholes.to_pylist(), True)
        flat, places = buffers(pa.concat_arrays([coded.dictionary.cast(pa.large_string()), wholes]))
        lists = []
        for blobs in zip(*ids) if ids else ((), ()):
            n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            lists += [np.frombuffer(b"".join(blobs), np.int32).astype(np.int64), np.concatenate([[0], np.cumsum(n)])]
        units = Aligned(self, flat, places, *lists)
        bad = np.concatenate([[0], np.cumsum(~units.valid[code])])[at]
        good = np.diff(bad) == 0
        return code[np.repeat(good, np.diff(at))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(at), 0))]), units


def _byte_level(path: str):
    """The encoding of one string by a byte-level vocabulary, its special tokens' strings being plain text, and the bytes of each id.

    Where every merge makes the id that follows the one before, ranks alone give the same ids, and the quicker library encodes.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    spelled = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))]
    with open(path, "rb") as f:
        stated = json.load(f)
    model, before = stated["model"], stated.get("pre_tokenizer") or {}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", ())]
    ranked = [model["vocab"].get(m) for m in merges] == [*range(256, 256 + len(merges))] and not stated.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
    if not ranked:
        return lambda u: tokenizer.encode(u, add_special_tokens=False).ids, spelled
    ranks = {spelled[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, spelled


_LISTS = ("a_ids", "b_ids", "a_ends", "b_ends")
LINKS = StructField("links", ArrayType(LongType()))
COUNTS = [StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups")]
FIELDS = StructType([*COUNTS, *(StructField(n, ArrayType(IntegerType())) for n in _LISTS), LINKS])
DIGESTS = StructType([*COUNTS, StructField("groups_sha256", StringType()), LINKS])


def _pair(paths: tuple[str, str, str]) -> Pair:
    return tokens.held(Pair, paths)


def _computed(paths: tuple[str, str, str], text: str, digests: bool):
    def gathered(flat, unit_at, code, at, kind):
        """The lists of all texts, from those of the units."""
        found = pa.LargeListArray.from_arrays(pa.array(unit_at), pa.array(flat, kind)).take(pa.array(code))
        bounds = np.frombuffer(found.buffers()[1], np.int64)[at] if len(code) else at
        return pa.LargeListArray.from_arrays(pa.array(bounds), found.values).cast(pa.list_(kind))

    def compute(batch: pa.RecordBatch) -> list:
        pair = _pair(paths)
        code, at, units = pair.align(strings(batch.column(text)))
        counts = [np.diff(np.concatenate([[0], np.cumsum(np.diff(x)[code])])[at]) for x in (units.a_at, units.b_at, units.group_at)]
        links = gathered(units.links, units.link_at, code, at, pa.int64())
        if digests:
            shown = units.shown(pair).take(pa.array(code))
            view = memoryview(shown.buffers()[2]) if len(code) else memoryview(b"")
            edge = np.frombuffer(shown.buffers()[1], np.int64)[at].tolist() if len(code) else at.tolist()
            return [*counts, [hashlib.sha256(view[i : j - 1]).hexdigest() if i < j else "" for i, j in zip(edge, edge[1:])], links]
        lists = [gathered(x.astype(np.int32), x_at, code, at, pa.int32()) for x, x_at in ((units.a, units.a_at), (units.b, units.b_at))]
        for which, unit_at in enumerate((units.a_at, units.b_at)):
            # ends within a unit become ends within the text
            n = np.diff(unit_at)[code]
            upto = np.cumsum(n) - n
            first = np.concatenate([upto, [0]])[at[:-1]] if len(code) else np.zeros(len(at) - 1, dtype=np.int64)
            shift = np.repeat(upto - np.repeat(first, np.diff(at)), np.diff(units.group_at)[code])
            own = gathered(units.ends(which).astype(np.int32), units.group_at, code, at, pa.int32())
            lists.append(pa.ListArray.from_arrays(own.offsets, pa.array((np.asarray(own.values) + shift).astype(np.int32))))
        return [*counts, *lists, links]

    return compute


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, link: str = "ends", text_col: str = "text", out: str = "aligned", carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The carried columns of docs and a struct `out`: numbers of tokens and groups, ids of A and B, how many A and B tokens end with each
    group, and links. With `digests` ids and ends come as the SHA-256 of "a1,a2|b1;a3|b2,b3" to keep rows small."""
    if link not in ("ends", "groups"):
        raise ValueError(f"link is 'ends' or 'groups', not {link!r}")
    paths = (a_path or tokens.default("byte_bpe_50k.json"), b_path or tokens.default("piece_bpe_32k.model"), link)
    return add_struct(docs, out, DIGESTS if digests else FIELDS, _computed(paths, text_col, digests), text=text_col, carry=carry)


def link_counts(rows: DataFrame, links: str, base: int) -> DataFrame:
    """(link, n, best): how often each link occurs in the lists of all rows, and whether no other of its B id occurs more often.
    Partial counts precede the shuffle; the highest counts are a row for each id of B, so they are broadcast."""
    counts = written(rows.select(F.explode(links).alias("link")).groupBy("link").agg(F.count("*").alias("n")), "links")
    most = counts.groupBy((F.col("link") % base).alias("b__")).agg(F.max("n").alias("most__"))
    return counts.join(F.broadcast(most), F.col("link") % base == F.col("b__")).select("link", "n", (F.col("n") == F.col("most__")).alias("best"))


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def corpus_links(docs: DataFrame, most_pairs: int = MOST_PAIRS, b_path: str | None = None, out: str = "aligned", **options) -> DataFrame:
    """align() of all docs, where `out` also has n_links, n_best (links whose count is the highest of their B id, ties included) and
    count_sum (over the links), and no lists of links."""
    base = vocabulary_size(b_path or tokens.default("piece_bpe_32k.model"))
    found = align(docs, b_path=b_path, out=out, **options)
    rows = written(found.withColumn("row__", F.monotonically_increasing_id()), "aligned")
    table = written(link_counts(rows, f"{out}.links", base), "link-counts")
    each = rows.select("row__", F.explode(f"{out}.links").alias("link__"))
    if table.count() <= most_pairs:
        known = each.join(F.broadcast(table), F.col("link__") == F.col("link"))
    else:
        known = joined_by_hot_key(each, "link__", table, "link")
    sums = known.groupBy(F.col("row__").alias("of__")).agg(F.sum("n").alias("sum__"), F.count(F.when(F.col("best"), 1)).alias("best__"))
    # the lists of links stay where they are
    counted = rows.withColumn(out, F.col(out).withField("n_links", F.size(f"{out}.links").cast("long")).dropFields("links"))
    joined = counted.join(sums, F.col("row__") == F.col("of__"), "left")
    whole = F.col(out).withField("n_best", F.coalesce("best__", F.lit(0))).withField("count_sum", F.coalesce("sum__", F.lit(0)))
    return joined.withColumn(out, whole).drop("row__", "of__", "sum__", "best__")
