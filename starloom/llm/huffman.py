"""Token ids as canonical, length-limited Huffman code in independent blocks.

The file format is a Parquet table with one row a block, in id order: part and block number, the
token count of the part before the block, the documents' ids and token counts, the code bits, and
the bit offset of every 256th token (checkpoints). Beside it lies the code table: the code length
of every id that occurs, at most 16 bits, from which the canonical codes follow. Any block can be
decoded alone, and any of its checkpoints is an entry; decoding steps all checkpoints of a block
together through one 2**16-entry table.

Defined results: null and empty texts are the end id alone; documents with equal ids stay separate, in
any order among themselves; null ids come first; an empty table writes no block and reads back empty.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm import tokens
from starloom.llm.shared import shared_dir, shuffle_partitions, written
from starloom.llm.text import buffers, slices, strings, word_spans

LIMIT = 16
STEP = 256
BLOCK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts, by package-merge."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Code:
    """A canonical code: symbols with their lengths; codes rise by (length, symbol)."""

    symbols: np.ndarray
    lengths: np.ndarray

    def codes(self) -> np.ndarray:
        order = np.lexsort((self.symbols, self.lengths))
        step = np.zeros(len(order), dtype=np.int64)
        size = 1 << (LIMIT - self.lengths[order])
        np.cumsum(size[:-1], out=step[1:])
        out = np.empty(len(order), dtype=np.int64)
        out[order] = step >> (LIMIT - self.lengths[order])
        return out

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by symbol."""
        top = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        code, length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.symbols], length[self.symbols] = self.codes(), self.lengths
        return code, length

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next 16 bits."""
        symbol, length = np.zeros(1 << LIMIT, np.int32), np.ones(1 << LIMIT, np.int64)
        order = np.lexsort((self.symbols, self.lengths))
        size = 1 << (LIMIT - self.lengths[order])
        filled = int(size.sum())
        symbol[:filled], length[:filled] = np.repeat(self.symbols[order], size), np.repeat(self.lengths[order], size)
        return symbol, length


def encode_block(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, first bit highest, and the bit offset of every STEP-th id."""
    n = length[ids]
    end = np.cumsum(n)
    begin = end - n
    word, room = begin >> 6, 64 - (begin & 63) - n
    value = code[ids]
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros((int(end[-1]) >> 6) + 2 if len(ids) else 1, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), begin[::STEP].astype(np.uint32)


def decode_block(payload: bytes, marks: np.ndarray, total: int, symbol: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints advance together."""
    raw = np.frombuffer(payload + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    at = marks.astype(np.int64)
    out = np.empty((STEP, len(marks)), dtype=np.int32)
    last = len(raw) - 3
    for k in range(min(STEP, total)):
        byte = np.minimum(at >> 3, last)
        next_ = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (8 - (at & 7))) & 0xFFFF
        out[k] = symbol[next_]
        at += length[next_]
    return out.T.reshape(-1)[:total]


def _tokenised(model: str, end_id: int):
    def run(batches):
        table = tokens.word_bpe(model)
        for b in slices(batches, "text", table.SLICE):
            data, offsets = buffers(strings(b.column("text")))
            ids, cuts = table.encode(data, *word_spans(data, offsets))
            wide = 2 if ids.max(initial=end_id) < 65536 else 4
            narrow, last = ids.astype(f"<u{wide}"), np.array([end_id], f"<u{wide}").tobytes()
            blobs = [narrow[x:y].tobytes() + last for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([wide] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["id", "wide", "ids"])

    return run


def _unpacked(wide: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{wide}").astype(np.int64)


def _counted(batches):
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        wide = np.asarray(b.column("wide"))
        for w in (2, 4):
            rows = b.column("ids").take(pa.array(np.flatnonzero(wide == w)))
            found = np.bincount(_unpacked(w, b"".join(rows.to_pylist())))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])


def _blocks(code: Code, id_type: pa.DataType):
    names = ["part", "block", "before", "ids", "sizes", "n_tokens", "payload", "marks"]

    def run(batches):
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        by_code, by_length = code.encoder()
        ids: list = []
        parts: list[np.ndarray] = []

        def flush():
            sizes = [len(p) for p in parts]
            payload, marks = encode_block(np.concatenate(parts), by_code, by_length)
            row = [part, block, before, ids, sizes, sum(sizes), payload, marks.astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        waiting = 0
        for b in batches:
            for i, w, x in zip(b.column("id").to_pylist(), b.column("wide").to_pylist(), b.column("ids").to_pylist()):
                ids.append(i)
                parts.append(_unpacked(w, x))
                waiting += len(parts[-1])
                if waiting >= BLOCK:
                    yield flush()
                    block, before, waiting, ids, parts = block + 1, before + waiting, 0, [], []
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, path: str, model: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Tokenises docs, codes the ids with global counts and writes blocks in id order under `path`.

    Only the counts by id, as many as the vocabulary has entries, come to the driver.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = named.schema["id"].dataType
    ids = written(named.mapInArrow(_tokenised(model or tokens.default("word_bpe_49k.json"), end_id), f"id {kind.simpleString()}, wide int, ids binary"), "ids")
    counts = ids.select("wide", "ids").mapInArrow(_counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").toPandas()
    symbols = counts["token"].to_numpy(dtype=np.int64)
    code = Code(symbols, code_lengths(counts["n"].to_numpy(dtype=np.int64)))
    spark.createDataFrame(list(zip(symbols.tolist(), code.lengths.tolist())), "token bigint, bits bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = ids.repartitionByRange(parts or shuffle_partitions(spark), "id").sortWithinPartitions("id")
    schema = f"part int, block int, before bigint, ids array<{kind.simpleString()}>, sizes array<int>, n_tokens bigint, payload binary, marks binary"
    ordered.mapInArrow(_blocks(code, to_arrow_type(kind)), schema).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def _decoded(code: Code, with_ids: bool):
    def run(batches):
        symbol, length = code.decoder()
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                ids = decode_block(row["payload"], np.frombuffer(row["marks"], "<u4"), row["n_tokens"], symbol, length)
                cuts = np.concatenate([[0], np.cumsum(row["sizes"])])
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])]
                whole = b.column("ids")[k].values
                start = cuts[:-1] + row["before"] + row["earlier"]
                arrays = [whole, pa.array(start), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a document, decoded from the blocks: id_col, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    table = spark.read.parquet(f"{path}/code").toPandas()
    code = Code(table["token"].to_numpy(dtype=np.int64), table["bits"].to_numpy(dtype=np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    earlier = totals.select(F.col("part").alias("p"), (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier"))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    joined = blocks.join(F.broadcast(earlier), F.col("part") == F.col("p")).drop("part", "block", "p")
    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return joined.mapInArrow(_decoded(code, with_ids), schema).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to a new folder beside the checkpoints and reads them back."""
    path = f"{shared_dir(docs.sparkSession)}/huffman-{uuid.uuid4().hex}"
    write(docs, path, **options)
    return read(docs.sparkSession, path, id_col=options.get("id_col", "doc_id"))
