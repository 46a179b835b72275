"""Document fingerprints by winnowing.

Every k-gram of code points is hashed by a rolling polynomial; of each window of w consecutive k-grams
the smallest hash is selected, the rightmost of equal ones, and its position is kept. Any passage of at
least w + k - 1 code points that two texts share leaves a common fingerprint in both; nothing shorter than
k can. Hashes are compared by their highest 40 bits.

Defined results: null text is empty and has no prints; two texts without prints are alike to 1.0, one
without and one with prints to 0.0; a text shorter than a k-gram has one print, of the whole text; one with
fewer k-grams than a window has their smallest. Equal texts have equal prints wherever they occur.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from starloom.llm.frames import add_struct
from starloom.llm.shared import shuffle_partitions
from starloom.llm.text import U64, mix, rolling, slices, sliding_min, strings


@dataclass(frozen=True)
class Params:
    gram: int = 16
    window: int = 32


FIELDS = StructType([StructField("hashes", ArrayType(LongType())), StructField("positions", ArrayType(IntegerType()))])
_LOW = 24
_MASK = (1 << _LOW) - 1


def _windows_min(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each window of w and its rightmost position. Hashes have 40 bits."""
    if len(h) <= _MASK:
        low = sliding_min(h << U64(_LOW) | U64(_MASK) - np.arange(len(h), dtype=U64), w)
        return low >> U64(_LOW), (U64(_MASK) - (low & U64(_MASK))).astype(np.int64)
    at, width = np.arange(len(h)), 1
    while width < w:
        step = min(width, w - width)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        width += step
    return h[at], at


def winnow(texts: list[str], p: Params = Params()) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of the selected k-grams of each text, by position."""
    k, w = p.gram, p.window
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64)
    begin = np.cumsum(sizes) - sizes
    every = mix(rolling(code, k)) >> U64(_LOW)
    low, at = _windows_min(every, w)
    out = []
    for b, n in zip(begin.tolist(), sizes.tolist()):
        grams = n - k + 1
        if n == 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        elif grams < 1:
            out.append((mix(rolling(code[b : b + n], n) + U64(n)).astype(U64) >> U64(_LOW), np.zeros(1, np.int64)))
        elif grams < w:
            own = every[b : b + grams]
            last = grams - 1 - int(own[::-1].argmin())
            out.append((own[last : last + 1], np.array([last])))
        else:
            place = at[b : b + grams - w + 1]
            new = np.ones(len(place), dtype=bool)
            new[1:] = place[1:] != place[:-1]
            out.append((low[b : b + grams - w + 1][new], place[new] - b))
    return [(h.astype(np.int64), x) for h, x in out]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of prints."""
    x, y = set(a.tolist()), set(b.tolist())
    if not x and not y:
        return 1.0
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def shown(hashes: np.ndarray) -> str:
    """The prints in order, ten hex digits each."""
    return hashes.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex(",", 5)


def fingerprints(docs: DataFrame, p: Params = Params(), text_col: str = "text", out: str = "prints", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs and a struct `out`: hashes and positions of the selected k-grams."""

    def compute(batch: pa.RecordBatch) -> list:
        found = winnow(strings(batch.column(text_col)).to_pylist(), p)
        return [pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))]

    return add_struct(docs, out, FIELDS, compute, text=text_col, carry=carry)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _chained(p: Params):
    """Rows come sorted by part; each row that is no ghost is compared with the row after it in its part."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_prints", "positions"]

    def run(batches):
        held = None
        for b in slices(batches, "text"):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("part", "ghost", "id", "text"))))
            prints = winnow([r[3] for r in rows], p)
            if held:
                rows, prints = [held[0], *rows], [held[1], *prints]
            held = rows[-1], prints[-1]
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
            again = winnow(changed, p)
            out: list[list] = [[] for _ in names]
            for i, t, (h, _) in zip(pairs, changed, again):
                own = prints[i][0]
                row = (rows[i][2], len(rows[i][3]), hashlib.sha256(t.encode()).hexdigest(), shown(own), shown(h), likeness(own, h), likeness(own, prints[i + 1][0]), len(own), ",".join(map(str, prints[i][1].tolist())))
                for column, x in zip(out, row):
                    column.append(x)
            kinds = [b.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def _splits(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Ends of `parts` stretches of (order, tie), from a sample of about 50 keys a part; they only lay out the work."""
    n = keys.count()
    share = min(1.0, 50 * parts / max(1, n))
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64("order", "tie", F.lit(3)), 1_000_000) < share * 1_000_000).collect())
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def compare_with_next(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its text edited with the next document's start, and against the next document; its prints and their places.

    The next document is the one with the next smaller id (null ids last, ties by a hash of the text); after the
    last comes the first. Ids are whole numbers. Rows are laid out in stretches of the order; the first row of
    each stretch is also sent, as a ghost, to the end of the one before, so texts are shuffled once.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.withColumns({"order": F.coalesce(F.col("id").cast("bigint"), F.lit(-(2**63))), "tie": F.xxhash64("text")})
    ends = _splits(named.select("order", "tie"), 4 * shuffle_partitions(spark))
    bound, tie_of = np.array([e[0] for e in ends], dtype=np.int64), ends

    def stretch(order: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Number of the stretch in falling order: how many ends are above (order, tie)."""
        import bisect

        below, upto = np.searchsorted(bound, order, "left"), np.searchsorted(bound, order, "right")
        place = upto.copy()
        for i in np.flatnonzero(below < upto):
            place[i] = bisect.bisect_right(tie_of, (int(order[i]), int(tie[i])))
        return len(bound) - place

    @F.pandas_udf("int")
    def part(order: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(stretch(order.to_numpy(), tie.to_numpy()).astype(np.int32))

    heads = named.select("order", "tie").withColumn("part", part("order", "tie")).groupBy("part").agg(F.max(F.struct("order", "tie")).alias("head")).collect()
    heads = sorted((r["part"], r["head"]["order"], r["head"]["tie"]) for r in heads)
    before = {(o, t): heads[k - 1][0] for k, (_, o, t) in enumerate(heads)}

    @F.pandas_udf("array<struct<part:int,ghost:boolean>>")
    def places(order: pd.Series, tie: pd.Series) -> pd.Series:
        own = stretch(order.to_numpy(), tie.to_numpy())
        ghosts = [before.get(k) for k in zip(order, tie)]
        return pd.Series([[{"part": a, "ghost": False}] if g is None else [{"part": a, "ghost": False}, {"part": g, "ghost": True}] for a, g in zip(own.tolist(), ghosts)])

    placed = named.select("id", "order", "tie", "text", F.explode(places("order", "tie")).alias("at")).select("id", "order", "tie", "text", "at.part", "at.ghost")
    placed = placed.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "ghost", F.col("order").desc(), F.col("tie").desc())
    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_prints bigint, positions string"
    return placed.select("part", "ghost", "id", "text").mapInArrow(_chained(p), schema).withColumnRenamed("id", id_col)
