"""Removal of passages that occur more than once in a corpus (substring dedup).

Rabin-Karp hashes of every window of `window` consecutive words are counted in Spark.
A window goes to the bucket of its minimiser, the smallest hash of its short sub-windows:
neighbouring windows mostly share it, so a run of them travels as one record (document key,
first word, hashes) and a window costs little more than its 8 bytes. Equal windows have equal
minimisers, so a bucket holds every copy. Within a task, repeats are first reduced to one
record, so a passage that a third of all rows share sends a record a task, not a row. Buckets are
counted first; one with more than `most` windows (many different windows around the same short
passage) is divided by the windows' own hashes, under which equal windows still meet.

Defined results: null text has no words; texts shorter than a window lose nothing; identical
rows (same id and text) count as several occurrences and all lose the passage; null ids are
ordinary ids. Two different windows are confused only if their 64-bit hashes and their buckets agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from starloom.llm.frames import add_struct
from starloom.llm.shared import shuffle_partitions
from starloom.llm.text import U64, binaries, buffers, mix, rolling, slices, sliding_min, strings, word_hashes, word_spans

WINDOW = 35
_CHUNK_BYTES = 4_000_000
#: Windows of one group: 16 MB of hashes, which a task holds a few times.
MOST_WINDOWS = 2_000_000
_BLOBS = "bucket int, hashes binary, known binary, a binary, b binary, first binary, size binary, done binary"
_SPANS = "a bigint, b bigint, first int, size int"
FIELDS = StructType([
    StructField("n_words", LongType()),
    StructField("n_removed", LongType()),
    StructField("spans", ArrayType(StructType([StructField("first", IntegerType()), StructField("end", IntegerType())]))),
    StructField("kept", StringType()),
])


def _runs(position: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where a new run of consecutive positions with equal companions begins."""
    new = np.ones(len(position), dtype=bool)
    if len(position):
        new[1:] = position[1:] != position[:-1] + 1
        for x in same:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _windows(window: int, buckets: int, hot: dict[int, int] | None = None):
    """Blobs of the windows by group; `hot` has the number of groups of buckets that are divided."""
    short = max(1, window // 4)
    parts = np.ones(buckets, dtype=np.int64)
    for k, n in (hot or {}).items():
        parts[k] = n
    before = np.cumsum(parts) - parts
    groups = int(parts.sum())

    def run(batches):
        for batch in slices(batches, "text", _CHUNK_BYTES):
            data, offsets = buffers(strings(batch.column("text")))
            starts, ends, words = word_spans(data, offsets)
            counts = np.diff(words)
            doc = np.repeat(np.arange(len(counts)), counts)
            h = word_hashes(data, starts, ends)
            whole = rolling(h, window)
            if not len(whole):
                continue
            low = sliding_min(mix(rolling(h, short)), window - short + 1)
            at = np.flatnonzero(doc[: len(whole)] == doc[window - 1 :])
            value, low = whole[at], mix(low[at])
            order = np.argsort(value, kind="stable")
            sorted_ = value[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = sorted_[1:] != sorted_[:-1]
            last = np.ones(len(order), dtype=bool)
            last[:-1] = first[1:]
            many = np.zeros(len(order), dtype=bool)
            many[order] = ~(first & last)
            known = order[first & ~last]
            single = np.flatnonzero(~many)
            a, b = (np.asarray(batch.column(k), dtype=np.int64) for k in ("a", "b"))
            bucket = (low % U64(buckets)).astype(np.int64)
            if hot:
                bucket = before[bucket] + (mix(value) % parts[bucket].astype(U64)).astype(np.int64)
            single = single[np.argsort(bucket[single], kind="stable")]
            known = known[np.argsort(bucket[known], kind="stable")]
            place = doc[at[single]]
            heads = _runs(at[single], place, bucket[single])
            sizes = np.diff(np.append(heads, len(single)))
            local = np.flatnonzero(many)
            ours = _runs(at[local], doc[at[local]])
            done = np.empty((len(ours), 4), dtype=np.int64)
            if len(ours):
                d = doc[at[local[ours]]]
                done[:] = np.stack([a[d], b[d], at[local[ours]] - words[d], np.diff(np.append(ours, len(local)))], axis=1)
            wanted = np.unique(np.concatenate([bucket[single], bucket[known]]))
            if not len(wanted):
                continue
            edges = np.append(wanted, groups)
            cut_single, cut_known = np.searchsorted(bucket[single], edges), np.searchsorted(bucket[known], edges)
            cut_run = np.searchsorted(heads, cut_single)
            d = doc[at[single[heads]]]
            rest = np.full(len(edges), done.size, dtype=np.int64)
            rest[0] = 0
            yield pa.RecordBatch.from_arrays([
                pa.array(wanted.astype(np.int32)), binaries(value[single], cut_single), binaries(value[known], cut_known),
                binaries(a[d], cut_run), binaries(b[d], cut_run), binaries((at[single[heads]] - words[d]).astype(np.int32), cut_run),
                binaries(sizes.astype(np.int32), cut_run), binaries(done.ravel(), rest),
            ], ["bucket", "hashes", "known", "a", "b", "first", "size", "done"])

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    """All items of a binary column of one group, in row order."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype=kind)


def _counted(table: pa.Table) -> pa.Table:
    """The spans of windows of one bucket that occur at least twice."""
    value, known = _joined(table, "hashes", U64), _joined(table, "known", U64)
    sorted_ = np.sort(np.concatenate([value, known]))
    twice = np.unique(np.concatenate([sorted_[1:][sorted_[1:] == sorted_[:-1]], known]))
    found = np.zeros(len(value), dtype=bool)
    if len(twice):
        found = twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value
    size = _joined(table, "size", np.int32).astype(np.int64)
    run = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    hit = np.flatnonzero(found)
    heads = _runs(hit, run[hit])
    r = run[hit[heads]]
    first = _joined(table, "first", np.int32)[r] + (hit[heads] - begin[r])
    done = _joined(table, "done", np.int64).reshape(-1, 4)
    columns = [_joined(table, "a", np.int64)[r], _joined(table, "b", np.int64)[r], first, np.diff(np.append(heads, len(hit)))]
    whole = [np.concatenate([x, done[:, i]]) for i, x in enumerate(columns)]
    kinds = [np.int64, np.int64, np.int32, np.int32]
    return pa.table([pa.array(x.astype(k)) for x, k in zip(whole, kinds)], ["a", "b", "first", "size"])


def _applied(window: int):
    def compute(batch: pa.RecordBatch) -> list:
        texts = strings(batch.column("text")).to_pylist()
        total, gone, spans, kept = [], [], [], []
        for t, found in zip(texts, batch.column("spans__").to_pylist()):
            words = t.encode().split()
            merged: list[dict] = []
            for x in sorted((x["first"], x["first"] + x["size"] + window - 1) for x in found or ()):
                if merged and x[0] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x[1])
                else:
                    merged.append({"first": x[0], "end": x[1]})
            left, at = [], 0
            for x in merged:
                left += words[at : x["first"]]
                at = x["end"]
            left += words[at:]
            total.append(len(words))
            gone.append(len(words) - len(left))
            spans.append(merged)
            kept.append(b" ".join(left).decode())
        return [total, gone, spans, kept]

    return compute


def _hot(texts: DataFrame, window: int, buckets: int, most: int) -> dict[int, int]:
    """Buckets of more than `most` windows, with the number of groups that each is divided into."""
    sizes = texts.mapInArrow(_windows(window, buckets), _BLOBS).groupBy("bucket").agg((F.sum(F.length("hashes") + F.length("known")) / 8).alias("n"))
    return {r.bucket: -int(-r.n // most) for r in sizes.filter(F.col("n") > most).collect()}


def remove_repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", out: str = "substring", carry: list[str] | None = None, buckets: int | None = None, most: int = MOST_WINDOWS) -> DataFrame:
    """The rows of docs with a struct `out`: n_words, n_removed, spans (maximal removed word intervals, end
    exclusive) and kept (the words left, joined by one space). Every word inside a window that starts at two or
    more places of the corpus goes. `buckets` defaults to four for each shuffle partition; one bucket is one group,
    or several of about `most` windows. Texts are read once more to count them.
    """
    buckets = buckets or 4 * shuffle_partitions(docs.sparkSession)
    a = F.xxhash64(F.col(id_col), F.col(text_col))
    b = F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))
    texts = docs.select(F.col(text_col).alias("text"), a.alias("a"), b.alias("b"))
    blobs = texts.mapInArrow(_windows(window, buckets, _hot(texts, window, buckets, most)), _BLOBS)
    spans = blobs.groupBy("bucket").applyInArrow(_counted, _SPANS)
    spans = spans.groupBy("a", "b").agg(F.collect_set(F.struct("first", "size")).alias("spans__"))
    spans = spans.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "spans__")
    left = [c for c in docs.columns if (carry is None or c in carry) and c.lower() != out.lower()]
    whole = text_col in left
    # all other columns as one, so no name of docs can clash
    row = F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in left if c != text_col)).alias("row")
    keyed = docs.select(row, F.col(text_col).alias("text"), a.alias("ka"), b.alias("kb"))
    joined = keyed.join(spans, (F.col("ka") == F.col("sa")) & (F.col("kb") == F.col("sb")), "left").select("row", "text", "spans__")
    made = add_struct(joined, "made", FIELDS, _applied(window), carry=["row", "text"] if whole else ["row"])
    return made.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in left), F.col("made").alias(out))
