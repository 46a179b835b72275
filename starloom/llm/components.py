"""Connected components of an undirected edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.shared import discarding, with_aggregates, written


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = with_aggregates(both, "u", 2 * total, F.min("v").alias("m"))
    return near.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges point from the greater to the smaller end."""
    near = with_aggregates(edges, "u", total, F.min("v").alias("m"))
    moved = F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u"))
    return near.select(moved.alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component. Loops and null ends are ignored.

    Each step is written to the shared folder; the driver sees a count and a checksum of it only. A centre
    with very many edges is joined by broadcast, so its rows stay where they are.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        with discarding(spark):
            stars = written(_large_star(edges, state[0]), "stars")
            edges = written(_small_star(stars, state[0]), "edges", keep=True)
        before, state = state, _state(edges)
        if before == state:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
