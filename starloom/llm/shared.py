"""Joins that hold under hot keys, and the written tables of starloom.sources.tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.sources.tables import delete, discarding, shared_dir, written

__all__ = ["HOT", "delete", "discarding", "joined_by_hot_key", "shared_dir", "shuffle_partitions", "with_aggregates", "written"]

#: A key with more than one in HOT of all rows is hot; there are at most HOT of them.
HOT = 1000


def with_aggregates(rows: DataFrame, key: str, total: int, *aggregates: Column, least_rows: int = 1) -> DataFrame:
    """The rows with the aggregates over all rows of their key, for keys of `least_rows` rows or more; null keys go.

    `total` is the number of rows or more. Aggregates are partial before their shuffle. A key of more than
    total / HOT rows is joined by broadcast, and by this bound at most HOT keys are; the rows of the other keys
    are shuffled, so that no key brings one task more than total / HOT rows.
    """
    per = rows.groupBy(F.col(key).alias("key__")).agg(*aggregates, F.count("*").alias("n__")).filter(F.col("n__") >= least_rows)
    often, same = F.col("n__") * HOT > total, F.col(key) == F.col("key__")
    hot, others = F.broadcast(per.filter(often)), per.filter(~often)
    seldom = rows.join(hot, same, "left_anti").join(others, same)
    return rows.join(hot, same).unionByName(seldom).drop("key__", "n__")


def joined_by_hot_key(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """rows left-joined with a table that has each key once. Keys of more than a HOT-th of all rows, at most HOT of them,
    are joined by broadcast, matched or not; the rows of the others are shuffled."""
    counts = rows.groupBy(F.col(key).alias("key__")).agg(F.count("*").alias("n__"))
    counts = written(counts, "counts")
    total = counts.agg(F.sum("n__")).first()[0] or 0
    often = counts.filter(F.col("n__") * HOT > total).select("key__")
    hot = F.broadcast(written(often.join(table, F.col("key__") == F.col(table_key), "left"), "hot"))
    same = F.col(key) == F.col("key__")
    seldom = rows.join(hot.select("key__"), same, "left_anti").join(table, F.col(key) == F.col(table_key), "left")
    return rows.join(hot, same).drop("key__").unionByName(seldom)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
