"""The driver's tables seen as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    whole = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86400.0
    return whole + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.extract(F.lit("SECOND"), ts).cast("double")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as one survey: a user is a scan, its events in time order are samples on a made-up path."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.lit(0).alias("survey_id"),
        F.col("user_id").cast("int").alias("scan_id"),
        (F.row_number().over(w) - 1).alias("sample_id"),
        epoch_seconds(F.col("ts")).alias("t"),
        (F.lit(100.0) + F.pmod("event_id", F.lit(97)) * 0.05).alias("ra"),
        (F.lit(20.0) + F.col("user_id") * 0.02 + F.pmod("event_id", F.lit(13)) * 0.01).alias("dec"),
        F.col("value").alias("flux"),
        (F.lit(1) + k % 5).cast("double").alias("dumps"),
        F.col("event_type").alias("state"),
    )


#: The same frame in DuckDB SQL.
EVENT_SAMPLES = """samples AS (
  SELECT 0 AS survey_id, user_id::INT AS scan_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS sample_id,
         epoch_us(ts) / 1e6 AS t, 100.0::DOUBLE + (event_id % 97) * 0.05::DOUBLE AS ra,
         20.0::DOUBLE + user_id * 0.02::DOUBLE + (event_id % 13) * 0.01::DOUBLE AS dec, value AS flux,
         (1 + (props->>'$.k')::INT % 5)::DOUBLE AS dumps, event_type AS state
  FROM events)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as spectra: one row of channels a vector, its label is the band."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("if_num"), F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as points on a plane, one row for each distinct place, with summed weights."""
    points = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") / 2500.0).cast("double").alias("y"),
        (F.col("l_discount") + 0.0).alias("z"), (F.lit(1.0) + F.col("l_tax")).alias("w"), (F.col("l_suppkey") % 7).cast("int").alias("scan_id"),
    )
    return points


SCATTER_POINTS = """points AS (
  SELECT l_quantity AS x, floor(l_extendedprice / 2500.0)::DOUBLE AS y, l_discount + 0.0 AS z, 1.0::DOUBLE + l_tax AS w, (l_suppkey % 7)::INT AS scan_id
  FROM lineitem)"""
