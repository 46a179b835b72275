"""Validation of SDFITS observations before a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import segment, spectral
from starloom.sources import readers


def validate(spark: SparkSession, paths: str | list[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Spectra of the files that pass: headers must be mappable (else an error names the file), times must parse, no
    physical value is negative, NaN channels are NULL and the channels are cut to start..stop (counted from 0).
    Only headers come to the driver, one a file."""
    for row in readers.read_headers(spark, paths).collect():
        header = dict(row["header"])
        if "DATE" in header and "OBSMODE" in header:
            try:
                segment.validate_header(header)
            except ValueError as e:
                raise ValueError(f"{row['path']}: {e}") from e
    s = readers.read_sdfits(spark, paths)
    s = segment.physical_rows(s, ["t", "el", "dumps", "obs_freq"])
    data = spectral.mask_nan(F.col("data"))
    return s.withColumn("data", spectral.channel_trim(data, start, stop) if start is not None and stop is not None else data)
