"""Written intermediate tables in the folder that the driver and all executors share.

A stage's result that is used more than once is written once and read back: that cuts the lineage and survives
lost executors. Inside `discarding` the tables written are deleted at its end, but for those kept.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster must set it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="starloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """The frame, written once as Parquet in the shared folder and read back. A kept table outlives the innermost `discarding`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stack = getattr(_open, "stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written inside it in this thread and not kept."""
    if not hasattr(_open, "stack"):
        _open.stack = []
    _open.stack.append([])
    try:
        yield
    finally:
        for path in _open.stack.pop():
            delete(spark, path)
