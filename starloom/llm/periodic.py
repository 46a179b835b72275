"""Runs of periodically repeated words, and texts with each run cut to its first period.

A run is a stretch of consecutive words with least period q and a length of at least max(least, times * q)
that no neighbouring word extends with that period. For every period p, grid points lie p words apart. A run of
period p holds four grid points in a row with equal words, so other points go at once; a point whose block before equals its own
block sees the run that the point before sees and goes too. For all points left, of all periods and texts of a slice,
one simultaneous binary search over prefix hashes finds how far the words p apart agree to the right and to the left.
Stretches found for several multiples of a period keep the least; each is then verified word by word.

Hashes are polynomials modulo two primes near 2**31 over exact word numbers. A stretch that fails its verification has its text searched
directly. The pairs of points are made in parts of at most PAIRS, so memory follows the longest text.

Defined results: null and empty texts have no words and no runs, and their collapsed text is empty; repeated rows are handled
alike; an empty table gives an empty one; an input column named as the output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from starloom.llm.frames import add_struct
from starloom.llm.text import buffers, packed_words, ragged, strings, word_spans

#: Pairs of (period, grid point) held at once.
PAIRS = 1 << 20
_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = (1_103_515_245, 1_664_525_011)

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
FIELDS = StructType([
    StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("best", RUN), StructField("collapsed", StringType()),
])


class _Prefixes:
    """Prefix hashes of a sequence of numbers under both primes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES):
            powers = np.ones(n + 1, dtype=np.int64)
            done = 1
            while done <= n:
                step = powers[done - 1] * base % prime
                size = min(done, n + 1 - done)
                powers[done : done + size] = powers[:size] * step % prime
                done += size
            terms = (codes.astype(np.int64) * 2654435761 % prime + 1) * powers[:n] % prime
            self.sums.append(np.concatenate([[0], np.cumsum(terms)]) % prime)
            self.powers.append(powers)

    def same(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` words from `at` and those from `at + period` have equal hashes."""
        out = np.ones(len(at), dtype=bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers):
            first = (sums[at + length] - sums[at]) % prime * powers[period] % prime
            other = (sums[at + period + length] - sums[at + period]) % prime
            out &= first == other
        return out

    def agree(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest length up to `most` for which the words after (or before) `at` and `at + period` agree, for all pairs at once."""
        low, high = np.zeros(len(at), dtype=np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            good = self.same(at[open_] - (middle if back else 0), period[open_], middle)
            low[open_[good]] = middle[good]
            high[open_[~good]] = middle[~good] - 1
        return low


def _direct(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches, by comparing the words of every period."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(codes) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], codes[:-p] == codes[p:], [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + p >= max(least, times * p):
                found.setdefault((a, b + p), p)
    return [(a, b, p) for (a, b), p in found.items()]


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period. `codes` are the words' numbers, of one
    text after another; text t has those from offsets[t] to offsets[t + 1]. `times` is 2 or more."""
    sizes = np.diff(offsets)
    hashes = _Prefixes(codes)
    # one row for each text and period
    text = np.repeat(np.arange(len(sizes)), sizes // times)
    period = ragged(np.ones(len(sizes), dtype=np.int64), sizes // times)
    points = (sizes[text] - 1) // period - (times - 2)
    total = np.cumsum(points)
    found, low = [], 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(low, high), points[low:high])
        p = period[own]
        base = offsets[text[own]]
        at = base + ragged(np.zeros(high - low, dtype=np.int64), points[low:high]) * p
        for k in range(1, times):
            keep = codes[at] == codes[at + k * p]
            own, p, base, at = own[keep], p[keep], base[keep], at[keep]
        known = at - base >= p
        known[known] = hashes.same(at[known] - p[known], p[known], p[known])
        own, p, base, at = own[~known], p[~known], base[~known], at[~known]
        end = offsets[text[own] + 1]
        start = at - hashes.agree(at, p, at - base, back=True)
        end = at + p + hashes.agree(at, p, end - at - p, back=False)
        keep = end - start >= np.maximum(least, times * p)
        found.append(np.stack([text[own[keep]], start[keep], end[keep], p[keep]], axis=1))
        low = high
    rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)
    rows = rows[first]
    wrong = {int(t) for t, a, b, p in rows.tolist() if not np.array_equal(codes[a : b - p], codes[a + p : b])}
    if wrong:
        rows = rows[~np.isin(rows[:, 0], list(wrong))]
        again = [(t, a + offsets[t], b + offsets[t], p) for t in wrong for a, b, p in _direct(codes[offsets[t] : offsets[t + 1]], least, times)]
        rows = np.concatenate([rows, np.array(again, dtype=np.int64).reshape(-1, 4)])
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return np.stack([rows[:, 0], rows[:, 1] - offsets[rows[:, 0]], rows[:, 2] - rows[:, 1], rows[:, 3]], axis=1)


def strongest(runs: np.ndarray) -> int:
    """Which of the rows (start, length, period) has the greatest length / period; ties go to the least start, then period."""
    ratio = runs[:, 1] / runs[:, 2]
    best = -1
    for k in np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12)).tolist():
        s, n, p = runs[k].tolist()
        if best < 0 or n * runs[best, 2] > runs[best, 1] * p or (n * runs[best, 2] == runs[best, 1] * p and (s, p) < (runs[best, 0], runs[best, 2])):
            best = k
    return best


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    before = np.concatenate([[0], np.cumsum(keep)])[at]
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1
    body = np.append(data, np.uint8(32))[ragged(starts, sizes)]
    stop = np.cumsum(sizes)
    body[stop - 1] = 32
    last = np.zeros(len(starts), dtype=bool)
    last[before[1:][np.diff(before) > 0] - 1] = True
    drop = np.ones(len(body), dtype=bool)
    drop[(stop - 1)[last]] = False
    bounds = np.concatenate([[0], np.cumsum(sizes - last)])[before]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(bounds), pa.py_buffer(body[drop]))


def _measured(text: str, least: int, times: int):
    def compute(batch: pa.RecordBatch) -> list:
        data, offsets = buffers(strings(batch.column(text)))
        starts, ends, at = word_spans(data, offsets)
        codes = np.asarray(packed_words(data, starts, ends).dictionary_encode().indices, dtype=np.int64)
        runs = find_runs(codes, at, least, times)
        gone = np.zeros(len(codes) + 1, dtype=np.int64)
        low = at[runs[:, 0]] + runs[:, 1]
        np.add.at(gone, low + runs[:, 3], 1)
        np.add.at(gone, low + runs[:, 2], -1)
        keep = np.cumsum(gone[:-1]) == 0
        cuts = np.searchsorted(runs[:, 0], np.arange(len(at)))
        three = [pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(three, RUN.names))
        best = [None] * (len(at) - 1)
        for t in np.unique(runs[:, 0]).tolist():
            own = runs[cuts[t] : cuts[t + 1], 1:]
            best[t] = dict(zip(RUN.names, own[strongest(own)].tolist()))
        return [np.diff(at), lists, best, _collapsed(data, starts, ends, at, keep)]

    return compute


def collapse(docs: DataFrame, least: int = 6, times: int = 4, text_col: str = "text", out: str = "periodic", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs and a struct `out`: the number of words, all runs (start, length, period; by start, then
    period), the one with the greatest length / period, and the text without the words that a run holds after its first period."""
    return add_struct(docs, out, FIELDS, _measured(text_col, least, times), text=text_col, carry=carry)
