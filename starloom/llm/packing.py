"""Sum-of-squares packing of token pieces into sequences of fixed length.

Texts longer than a sequence are cut; full pieces are sequences of their own. The others are
packed by the sum-of-squares rule: a piece goes where, afterwards, the sum over all gaps of the
squared number of open sequences with that gap is smallest. The state is a count for each gap, so
memory and time a piece depend on the sequence length alone.

Pieces are dealt at random over shards of about `shard_pieces` pieces; a shard is one task's work,
takes its pieces from long to short, and loses only its own last few sequences to the cut. Spark
shuffles piece lengths and keys for this, never ids.

Defined results: null text is empty and yields the piece of the separator alone; repeated ids are
separate documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import tokens
from starloom.llm.shared import written
from starloom.llm.text import buffers, slices, strings, word_spans

LENGTH = 2048
SHARD_PIECES = 100_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order.

    Moving a sequence from gap g to gap g - s changes the sum of squares by 2 * (N[g-s] - N[g] + 1), and
    filling one by 1 - 2 * N[g]; gap 0 does not count. A new sequence opens only where no open one has room.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    where = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    for i, s in enumerate(lengths.tolist()):
        best = -1
        gaps = np.flatnonzero(count[s:]) + s
        if len(gaps):
            change = 2 * (count[gaps - s] - count[gaps] + 1)
            if gaps[0] == s:
                change[0] = 1 - 2 * count[s]
            best = int(gaps[change.argmin()])
        if best < 0:
            where[i], offset[i] = len(filled), 0
            filled.append(s)
            gap = capacity - s
            if gap:
                open_[gap].append(int(where[i]))
                count[gap] += 1
            continue
        b = open_[best].pop()
        count[best] -= 1
        where[i], offset[i] = b, filled[b]
        filled[b] += s
        if best > s:
            open_[best - s].append(b)
            count[best - s] += 1
    return where, offset


def _pieces(model: str, length: int, separator: int, with_ids: bool):
    def run(batches):
        table = tokens.word_bpe(model)
        for b in slices(batches, "text", table.SLICE):
            data, offsets = buffers(strings(b.column("text")))
            ids, cuts = table.encode(data, *word_spans(data, offsets))
            row, piece, start, size, crc, kept = [], [], [], [], [], []
            for i in range(b.num_rows):
                own = np.append(ids[cuts[i] : cuts[i + 1]], separator).astype("<u4")
                for k, at in enumerate(range(0, len(own), length)):
                    part = own[at : at + length]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    kept.append(part)
            arrays = [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _packed(length: int):
    """Packs the rows (row__, length) of one shard, which come sorted by falling length."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        where, offset = sum_of_squares(np.asarray(table.column("length")), length)
        table = table.drop_columns(["length"]).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    return run


def pieces(docs: DataFrame, model: str | None = None, length: int = LENGTH, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most `length` ids of every document, its separator included."""
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return named.mapInArrow(_pieces(model or tokens.default("word_bpe_49k.json"), length, separator, with_ids), schema).withColumnRenamed("id", id_col)


def pack(parts: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The rows of parts (columns of `pieces`) with sequence_id and offset.

    The pieces are written once, so that they are made once, counted, and numbered. Shards get numbers and lengths
    alone; a shard of `shard_pieces` of them fits any task and costs at most about one sequence more than packing
    everything together. Sequence numbers and offsets are then joined to the pieces, ids and all.
    """
    wanted = parts.columns
    parts = written(parts.withColumn("row__", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-parts.count() // shard_pieces))
    dealt = parts.select("row__", "length").repartition(shards, F.xxhash64("row__")).sortWithinPartitions(F.col("length").desc(), "row__")
    placed = dealt.mapInArrow(_packed(length), "row__ bigint, sequence_id bigint, offset bigint")
    return parts.join(placed, "row__").select(*wanted, "sequence_id", "offset")
