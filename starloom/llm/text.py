"""Shared vectorised text helpers that run inside Arrow tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D. UTF-8 never uses
those bytes inside a character, so everything here works on the raw Arrow buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; it bounds a task's memory whatever the batch size.
SLICE_BYTES = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=U64) * U64(2) + U64(1)
_BASE = int(_rng.integers(2**60, 2**61)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_SPAN = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, _SPAN)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one plain string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (one more entry than texts)."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, finalised with the length."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, side="right")))
        low = int(starts[i])
        part = data[low : int(ends[j - 1])]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0x9E3779B97F4A7C15))
        i = j
    return out


def rolling(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every k consecutive values, by doubling; len(h) - k + 1 values."""
    if len(h) < k:
        return np.zeros(0, dtype=U64)
    parts, width, done, acc = h, 1, 0, None
    rest = k
    while rest:
        if rest & 1:
            here = parts[done : done + len(h) - k + 1]
            acc = here.copy() if acc is None else acc * U64(pow(base, width, 2**64)) + here
            done += width
        rest >>= 1
        if rest:
            parts = parts[:-width] * U64(pow(base, width, 2**64)) + parts[width:]
            width *= 2
    return acc


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(x) < w:
        return np.zeros(0, dtype=x.dtype)
    m, width = x, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return m if width == w else np.minimum(m[: len(x) - w + 1], m[w - width : w - width + len(x) - w + 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every piece, one piece after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as one Arrow string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = data[ragged(starts, lengths)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))


def binaries(pieces: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive slices of an array's bytes as a binary column; offsets count items."""
    raw = np.ascontiguousarray(pieces)
    at = pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int64) * raw.itemsize))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, at, pa.py_buffer(raw)]).cast(pa.binary())


def code_points(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.utf8_length(column), dtype=np.int64)
