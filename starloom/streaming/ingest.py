"""Observations that arrive as files are appended to a table of samples as they come.

Observations are bounded: there is no windowed state and no late data. A stream of files with a checkpoint is
the batch discovery of files that remembers what it has taken.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from starloom.sources.readers import SPECTRA, _sdfits_rows


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str, glob: str = "*.fits") -> StreamingQuery:
    """Takes all SDFITS files that are new since the last call and ends."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    rows = files.filter("not contains(path, '_validated')").select("path", "content").mapInPandas(_sdfits_rows(None), SPECTRA)
    return rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
