"""Adding one struct column to a frame with an Arrow function."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from starloom.llm.text import SLICE_BYTES, slices


def add_struct(df: DataFrame, out: str, fields: StructType, compute: Callable[[pa.RecordBatch], list], text: str = "text", carry: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """The carried columns of df (all by default) and the struct column `out`.

    `compute` gets a record batch of the whole input and returns one array for each field.
    An input column named `out` is replaced, so clashing names do no harm.
    """
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower() and (carry is None or f.name in carry)]
    schema = StructType([*kept, StructField(out, fields)])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]
    keep = [f.name for f in kept]

    def run(batches):
        for b in slices(batches, text, limit):
            made = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(compute(b), types)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.StructArray.from_arrays(made, names)], [*keep, out])

    return df.mapInArrow(run, schema)
