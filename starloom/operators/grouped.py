"""Groups as runs of sorted rows inside Arrow tasks, and small aggregates joined to all rows of a survey."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from starloom.sources.tables import written

#: Surveys whose aggregates are broadcast at most, after they were counted; more are joined by a shuffle.
SURVEYS = 100_000


def _new_groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        same = np.ones(table.num_rows - 1, dtype=bool)
        for k in keys:
            c = table.column(k).combine_chunks()
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            same &= np.asarray(equal)
        new[1:] = ~same
    return new


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows, sorted by key, as tables of whole groups, and where each group begins (one more entry than groups)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        first, last = held[0], held[-1]
        if all(first.column(k)[0] == last.column(k)[-1] for k in keys):
            continue  # one group so far
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(_new_groups(table, keys))
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
            held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(np.flatnonzero(_new_groups(table, keys)), table.num_rows)


def _doubles(table: pa.Table, columns: list[str]) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(float) for c in columns]


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows by key, sorted, in as many tasks as shuffles have: groups cost time, not bytes, so small tasks are not joined."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def summarised(df: DataFrame, keys: list[str], columns: list[str], schema: str, compute: Callable[..., tuple], order: list[str] = (), together: bool = False) -> DataFrame:
    """One row a group: its keys and what compute returns for the arrays of its columns (doubles), sorted by `order`.

    Rows are shuffled by key and sorted, and a task walks over its groups in Arrow batches, so a group costs no
    frame of its own. Only keys and columns travel; a task holds the rows of one group and a batch. A compute that handles groups
    `together` gets the arrays of many of them and where each begins (one more entry than groups), and returns arrays of a value a group.
    """
    made = df.sparkSession.createDataFrame([], schema).schema
    out = StructType([*(df.schema[k] for k in keys), *made])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, keys):
            arrays = _doubles(table, columns)
            cols = compute(*arrays, starts) if together else [list(c) for c in zip(*(compute(*(x[a:b] for x in arrays)) for a, b in zip(starts, starts[1:])))]
            found = [table.column(k).take(pa.array(starts[:-1])).combine_chunks() for k in keys]
            found = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in found]
            yield pa.RecordBatch.from_arrays([*(x.cast(t) for x, t in zip(found, kinds)), *(pa.array(c, t) for c, t in zip(cols, kinds[len(keys) :]))], out.names)

    names = list(dict.fromkeys([*keys, *columns, *order]))
    return _dealt(df.select(*names), keys, order).mapInArrow(run, out)


def extended(df: DataFrame, keys: list[str], columns: list[str], schema: str, compute: Callable[..., tuple], order: list[str] = ()) -> DataFrame:
    """df with the columns of the schema, which replace those of these names: compute gets the arrays of many groups' columns (doubles), a group's
    rows sorted by `order`, and where each group begins (one more entry than groups), and returns arrays of a value a row."""
    made = df.sparkSession.createDataFrame([], schema).schema
    kept = [f for f in df.schema.fields if f.name not in made.names]
    out = StructType([*kept, *made])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, keys):
            cols = compute(*_doubles(table, columns), starts)
            arrays = [*(table.column(f.name) for f in kept), *map(pa.array, cols)]
            yield from pa.Table.from_arrays([x.cast(t) for x, t in zip(arrays, kinds)], out.names).combine_chunks().to_batches()

    return _dealt(df, keys, order).mapInArrow(run, out)


def with_survey(samples: DataFrame, key: str = "survey_id", **aggregates: Column) -> DataFrame:
    """samples with aggregates over all rows of their survey. The aggregates, a row a survey, are partial before their
    shuffle, written, counted and broadcast; samples are not moved."""
    per = written(samples.groupBy(F.col(key).alias("survey__")).agg(*(c.alias(n) for n, c in aggregates.items())), "surveys")
    side = F.broadcast(per) if per.count() <= SURVEYS else per
    return samples.join(side, F.col(key).eqNullSafe(F.col("survey__")), "left").drop("survey__")
