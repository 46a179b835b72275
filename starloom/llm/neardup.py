"""Near-duplicate documents by SetSketch registers, verified on full shingle sets.

A text's set of shingles becomes `registers` SetSketch registers: exponentially spaced, truncated
minima of hashed elements. Sketches of parts merge by the larger register, and registers of two
sets agree the more often the more alike they are. Bands of registers propose groups; inside a
proposed group pairs pass a joint maximum-likelihood test of their registers and known sizes, and
every link is then confirmed on the full sets.

Only connectivity is asked for, so no pairs are listed: equal sets are one class. Inside each band
bucket the likelihood test of registers and sizes comes first, without texts: members that pass it with
the bucket's smallest class are joined to it; in a bucket where some fail, a breadth-first search finds
the components of likely links (a bucket of more than `bucket_classes` classes keeps its star of edges,
which joins no less). So chance collisions of bands do not chain unlike texts to one giant group. The
components of these edges are the proposed groups, and a breadth-first search over each group confirms
links on the full sets, only towards classes it has not reached. A group of more than `group_shingles`
shingles is cut into blocks (see _confirmed), so that no task holds an unbounded group.

A pair at the threshold misses all bands with a chance of (1 - 0.8**6)**48 = 5e-7 at the defaults,
and fails the likelihood test (a margin of 0.2, over five standard deviations) with about 1e-7. A pair of
similarity 0.1, as unlike texts of one language have in two-word shingles, shares a band with 5e-5.

Defined results: null, empty and blank texts have an empty set, link with nothing and are kept;
shorter texts than a shingle are one shingle; rows with equal ids are separate rows that share
the id's verdict; null ids never name a component and are kept only where no row of theirs has an id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.components import components
from starloom.llm.shared import discarding, shuffle_partitions, with_aggregates, written
from starloom.llm.text import LOWER, U64, buffers, mix, ragged, rolling, slices, strings, word_hashes, word_spans


@dataclass(frozen=True)
class Params:
    """Link when over * |A and B| >= under * |A or B|. SetSketch: base and rate; `rows` registers make a band; the first
    `tested` registers travel for the likelihood test."""

    shingle: int = 5
    under: int = 80
    over: int = 100
    rows: int = 6
    bands: int = 48
    tested: int = 128
    base: float = 1.001
    rate: float = 20.0
    margin: float = 0.2
    group_shingles: int = 100_000
    bucket_classes: int = 2_000

    @property
    def registers(self) -> int:
        return self.rows * self.bands


_FACTORS = np.random.default_rng(7).integers(1, 2**62, size=4096, dtype=U64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted within a text, and where each text's begin."""
    data, offsets = buffers(texts)
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    every = mix(rolling(h, k)) if k > 1 else h
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        n = b - a
        if n >= k:
            parts.append(np.unique(every[a : b - k + 1]))
        elif n:
            parts.append(mix(rolling(h[a:b], n) ^ U64(n)))
        else:
            parts.append(every[:0])
    cuts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=cuts[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), cuts


def registers(values: np.ndarray, cuts: np.ndarray, p: Params, count: int | None = None) -> np.ndarray:
    """One row of uint16 registers (the first `count`) for each text; a text without elements has zeros."""
    sizes = np.diff(cuts)
    full = np.flatnonzero(sizes)
    count = count or p.registers
    out = np.zeros((len(sizes), count), dtype=np.uint16)
    if len(full):
        low = np.empty((len(full), count), dtype=U64)
        heads = cuts[full]
        for i in range(count):
            low[:, i] = np.minimum.reduceat(values * _FACTORS[i], heads)
        exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / p.rate
        level = np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(p.base))
        out[full] = np.clip(level, 0, 2**16 - 1).astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key for each text and band."""
    keys = np.zeros((len(sketch), p.bands), dtype=U64)
    salt = _FACTORS[p.registers : p.registers + p.bands]
    for r in range(p.rows):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + sketch[:, r :: p.rows].astype(U64) + salt)
    return keys


def likely(x: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray, p: Params) -> np.ndarray:
    """Whether the joint likelihood of registers and sizes is still rising at the threshold less the margin."""
    cut = p.under / p.over - p.margin
    higher = (x > others).sum(axis=1)
    equal = (x == others).sum(axis=1)
    lower = x.shape[-1] - higher - equal
    u = n / (n + sizes)
    v = 1 - u
    b = p.base
    a1, a2 = np.maximum(u - v * cut, 1e-9), np.maximum(v - u * cut, 1e-9)
    rest1, rest2 = 1 - a1 * (b - 1) / b, 1 - a2 * (b - 1) / b
    p1, p2 = -np.log(rest1) / np.log(b), -np.log(rest2) / np.log(b)
    d1, d2 = (b - 1) / b / (np.log(b) * rest1), (b - 1) / b / (np.log(b) * rest2)
    slope = equal * (v * d1 + u * d2) / np.maximum(1 - p1 - p2, 1e-9) - higher * v * d1 / p1 - lower * u * d2 / p2
    return slope >= 0


def linked_roots(values: np.ndarray, cuts: np.ndarray, p: Params) -> np.ndarray:
    """For each set the first set of its component of confirmed links, by breadth-first search."""
    n = np.diff(cuts)
    code = np.unique(values, return_inverse=True)[1]
    sketch = registers(values, cuts, p, p.tested)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, dtype=bool)
    root = np.full(len(n), -1, dtype=np.int64)
    open_ = np.flatnonzero(n)
    root[n == 0] = np.flatnonzero(n == 0)
    while len(open_):
        first, open_ = int(open_[0]), open_[1:]
        root[first] = first
        front = [first]
        while front and len(open_):
            x = front.pop()
            near = (n[open_] * p.over >= n[x] * p.under) & (n[x] * p.over >= n[open_] * p.under)
            near = open_[near]
            if len(near):
                near = near[likely(sketch[x], sketch[near], int(n[x]), n[near], p)]
            if not len(near):
                continue
            own = code[cuts[x] : cuts[x + 1]]
            mark[own] = True
            hits = mark[code[ragged(cuts[near], n[near])]]
            both = np.add.reduceat(hits, np.cumsum(n[near]) - n[near], dtype=np.int64)
            mark[own] = False
            found = near[both * p.over >= (n[x] + n[near] - both) * p.under]
            if len(found):
                root[found] = first
                front += found.tolist()
                open_ = open_[root[open_] < 0]
    return root


def _sketched(p: Params):
    def run(batches):
        for b in slices(batches, "text"):
            values, cuts = shingle_sets(strings(b.column("text")), p.shingle)
            sketch = registers(values, cuts, p)
            keys = band_keys(sketch, p)
            n = np.diff(cuts)
            sid = [hashlib.blake2b(values[a:e].tobytes(), digest_size=16).digest() for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("id"), pa.array(sid, pa.binary()), pa.array(n), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in sketch[:, : p.tested]], pa.binary())], ["a", "b", "id", "sid", "n", "keys", "registers"])

    return run


def _banded(bands: int):
    def run(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("sid").take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], ["key", "sid"])

    return run


def likely_roots(sketch: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """For each class of a bucket the first class of its component of likely links, by breadth-first search."""
    root = np.full(len(n), -1, dtype=np.int64)
    open_ = np.arange(len(n))
    while len(open_):
        first, open_ = int(open_[0]), open_[1:]
        root[first] = first
        front = [first]
        while front and len(open_):
            x = front.pop()
            found = open_[_alike(sketch[x], int(n[x]), sketch[open_], n[open_], p)]
            root[found] = first
            front += found.tolist()
            open_ = open_[root[open_] < 0]
    return root


def _alike(x: np.ndarray, n: np.ndarray | int, others: np.ndarray, sizes: np.ndarray, p: Params) -> np.ndarray:
    """Whether sizes allow a link and the registers make it likely; x and n may hold one row for each other."""
    return (sizes * p.over >= n * p.under) & (n * p.over >= sizes * p.under) & likely(x, others, n, sizes, p)


def _likely_edges(p: Params):
    """Rows (key, sid, n, registers) come sorted by key and class; edges (u, v) of each bucket's likely links leave."""

    def edges(key: np.ndarray, sid: pa.Array, n: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(key)))
        to = np.repeat(head, size)
        good = np.ones(len(key), dtype=bool)
        rest = np.flatnonzero(~new)
        good[rest] = _alike(sketch[to[rest]], n[to[rest]], sketch[rest], n[rest], p)
        mixed = np.flatnonzero(np.add.reduceat(~good, head) > 0)
        for k in mixed[size[mixed] <= p.bucket_classes].tolist():
            a, b = head[k], head[k] + size[k]
            to[a:b] = a + likely_roots(sketch[a:b], n[a:b], p)
        move = np.flatnonzero(to != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([sid.take(pa.array(move)), sid.take(pa.array(to[move]))], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            made = table.column("registers").combine_chunks().to_pylist()
            sketch = np.frombuffer(b"".join(made), dtype=np.uint16).reshape(len(made), p.tested)
            return edges(np.asarray(table.column("key")), table.column("sid").combine_chunks(), np.asarray(table.column("n")), sketch)

        for b in batches:
            if not b.num_rows:
                continue
            # whole buckets only: what belongs to the last key waits for the next batch
            key = np.asarray(b.column("key"))
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut == 0 and (not held or held[-1].column("key")[-1].as_py() == key[0]):
                held.append(b)
                continue
            held.append(b.slice(0, cut))
            yield emit()
            held = [b.slice(cut)]
        if held:
            yield emit()

    return run


def _verified(p: Params):
    """Rows come sorted by group and class; a group's confirmed components leave as edges (sid, root)."""

    def links(sids: list[bytes], texts: list[str]) -> pa.RecordBatch:
        values, cuts = shingle_sets(pa.array(texts, pa.large_string()), p.shingle)
        root = linked_roots(values, cuts, p)
        move = np.flatnonzero(root != np.arange(len(root))).tolist()
        return pa.RecordBatch.from_arrays([pa.array([sids[i] for i in move], pa.binary()), pa.array([sids[root[i]] for i in move], pa.binary())], ["u", "v"])

    def run(batches):
        group, sids, texts = None, [], []
        for b in batches:
            for g, i, j, s, t in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "sid", "text"))):
                if (g, i, j) != group:
                    if len(sids) > 1:
                        yield links(sids, texts)
                    group, sids, texts = (g, i, j), [], []
                if sids and sids[-1] == s:  # a repeated row, or one that two sides of a pair of blocks share
                    continue
                sids.append(s)
                texts.append(t)
        if len(sids) > 1:
            yield links(sids, texts)

    return run


def _confirmed(keyed: DataFrame, members: DataFrame, total: int, p: Params) -> DataFrame:
    """(node, root) of the components of confirmed links between the members (root, sid, ma, mb, n) of proposed groups.

    A group of at most `group_shingles` shingles is searched whole. A larger one is cut into blocks. First each block
    is searched together with the group's pivot, its least member, which joins what is alike to one large component.
    Then only links with a member outside the group's largest component can be missing: those members are cut into
    blocks of their own, and each pair of a block of the rest and a block of the group is searched.
    """

    def searched(placed: DataFrame) -> DataFrame:
        texts = keyed.select("a", "b", "text").join(placed, (F.col("a") == F.col("ma")) & (F.col("b") == F.col("mb"))).select("root", "i", "j", "sid", "text")
        texts = texts.repartition(shuffle_partitions(keyed.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "sid")
        return written(texts.mapInArrow(_verified(p), "u binary, v binary"), "links")

    def block(*key):
        return F.pmod(F.xxhash64(*key[:-1]), key[-1])

    def upto(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    halves = lambda weight: F.ceil(weight * 2 / F.lit(p.group_shingles))
    place, columns = ("root", "i", "j", "sid", "ma", "mb"), ("root", "sid", "ma", "mb")
    sized = with_aggregates(members, "root", total, F.sum("n").alias("weight"), F.min("sid").alias("pivot"))
    sized = sized.withColumn("blocks", F.when(F.col("weight") <= p.group_shingles, F.lit(1).cast("bigint")).otherwise(halves(F.col("weight"))))
    sized = written(sized.withColumn("own", block("sid", F.col("blocks"))), "sized")
    large = sized.filter("blocks > 1")
    none = F.lit(0).cast("bigint").alias("j")
    pivots = large.filter("sid = pivot").select(*columns, "own", upto(F.col("blocks")).alias("i")).filter("i <> own")
    links = searched(sized.select(*columns, F.col("own").alias("i"), none).select(*place).unionByName(pivots.select(*columns, "i", none).select(*place)))
    roots = components(links)
    if large.isEmpty():
        return roots
    now = large.join(roots.select("node", F.col("root").alias("to")), F.col("sid") == F.col("node"), "left").withColumn("part", F.coalesce("to", "sid")).drop("node", "to")
    now = written(with_aggregates(now, "part", total, F.count("*").alias("size")), "parts")
    now = with_aggregates(now, "root", total, F.max(F.struct("size", "part")).alias("main")).withColumn("rest", F.col("part") != F.col("main.part"))
    now = written(now.drop("main", "part", "size"), "rest")
    now = with_aggregates(now, "root", total, F.sum(F.when(F.col("rest"), F.col("n"))).alias("left")).filter("left > 0").withColumn("others", halves(F.col("left")))
    now = written(now, "pairs")
    whole = now.select(*columns, F.col("own").alias("i"), upto(F.col("others")).alias("j"))
    rest = now.filter("rest").select(*columns, block(F.lit(1), F.col("sid"), F.col("others")).alias("j"), upto(F.col("blocks")).alias("i"))
    more = searched(whole.select(*place).unionByName(rest.select(*place)))
    return components(links.unionByName(more))


def _proposed(led: DataFrame, sketch: DataFrame, p: Params) -> DataFrame:
    """Edges (u, v) of likely links between the classes of each band bucket of led (key, sid, lead, size)."""
    crowded = led.filter(F.col("size") > p.bucket_classes).filter("sid > lead").select(F.col("sid").alias("u"), F.col("lead").alias("v"))
    small = led.filter(F.col("size") <= p.bucket_classes).select("key", F.col("sid").alias("own"))
    once = sketch.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("registers").alias("registers"))
    rows = small.join(once, F.col("own") == F.col("sid")).select("key", "sid", "n", "registers")
    rows = rows.repartition(shuffle_partitions(led.sparkSession), "key").sortWithinPartitions("key", "sid")
    return rows.mapInArrow(_likely_edges(p), "u binary, v binary").unionByName(crowded)


def near_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id (the smallest id reachable over links), kept
    (whether that is the row's own id), chosen (true for one row of each component and for all rows without
    shingles; identical rows share it), and a and b, two 64-bit hashes of id and text that name the row.
    The result is a written table; all tables on the way to it are deleted."""
    with discarding(docs.sparkSession):
        return written(_named(docs, p, id_col, text_col), "duplicates", keep=True)


def _named(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_duplicates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("b"))
    id_type = keyed.schema["id"].dataType.simpleString()
    sketch = written(keyed.mapInArrow(_sketched(p), f"a bigint, b bigint, id {id_type}, sid binary, n bigint, keys binary, registers binary"), "sketch")
    classes = sketch.filter("n > 0").groupBy("sid").agg(F.first("keys").alias("keys"))
    banded = classes.mapInArrow(_banded(p.bands), "key bigint, sid binary")
    total = sketch.count()
    led = with_aggregates(banded, "key", p.bands * total, F.min("sid").alias("lead"), F.count("*").alias("size"), least_rows=2)
    led = written(led, "buckets")
    groups = components(_proposed(led, sketch, p))
    one = sketch.filter("n > 0").groupBy("sid").agg(F.min(F.struct("a", "b", "n")).alias("row"))
    members = groups.join(one, F.col("node") == F.col("sid")).select("root", "sid", F.col("row.a").alias("ma"), F.col("row.b").alias("mb"), F.col("row.n").alias("n"))
    roots = _confirmed(keyed, written(members, "members"), total, p)
    # the row with the smallest id, null ids last and ties by the row's hashes, stands for its class and component
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "a", "b")
    named = sketch.groupBy("sid").agg(F.min(place).alias("least")).join(roots, F.col("sid") == F.col("node"), "left")
    named = named.select(F.coalesce("root", "sid").alias("root"), "sid", "least")
    named = with_aggregates(named, "root", total, F.min("least").alias("first")).select(F.col("sid").alias("s"), "first")
    found = sketch.select("id", "a", "b", "sid", "n").join(named, F.col("sid") == F.col("s"))
    component = F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))
    chosen = (F.col("n") == 0) | (F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b"))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")]
    return found.select(*columns, chosen.alias("chosen"), "a", "b")


def without_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, by near_duplicates; of identical rows (id and text) one stays."""
    chosen = near_duplicates(docs, p, id_col, text_col).filter("chosen").select(F.col("a").alias("ca"), F.col("b").alias("cb")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the row as one column, so no name of docs can clash
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.col(id_col), text).alias("ka"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("kb"))
    kept = keyed.join(chosen, (F.col("ka") == F.col("ca")) & (F.col("kb") == F.col("cb")), "left_semi")
    return kept.dropDuplicates(["ka", "kb"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
