"""Weighted sums as built-in aggregates, and what follows from them in closed form."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_mean(y: Column, w: Column) -> Column:
    return F.sum(w * y) / F.sum(w)


def reliability_stdev(y: Column, w: Column, delta: float = 1.0) -> Column:
    """Root of sum(w y^2) over sum(w) less delta * sum(w^2) / sum(w); y are deviations."""
    return F.sqrt(F.sum(w * y * y) / (F.sum(w) - delta * F.sum(w * w) / F.sum(w)))


def weighted_line(x: Column, y: Column, w: Column) -> tuple[Column, Column]:
    """Intercept and slope of the weighted regression; NULL where singular."""
    s, sx, sy, sxx, sxy = F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)
    d = s * sxx - sx * sx
    slope = F.when(F.abs(d) > 1e-12, (s * sxy - sx * sy) / d)
    return (sy - slope * sx) / s, slope


def anchored_line(x: Column, y: Column, w: Column, x0: float = 0.0, y0: float = 0.0) -> Column:
    """Slope of the weighted regression through (x0, y0)."""
    return F.sum(w * (x - x0) * (y - y0)) / F.sum(w * (x - x0) * (x - x0))


def interpolated_rank(df: DataFrame, keys: list[str], y: str, w: str, fraction: float, out: str) -> DataFrame:
    """One row a key with the value of y at a fraction of the summed weights, linear between points.

    A point stands at the weight below it plus `fraction` of its own; 0.5 gives the weighted median and
    0.682689 the weighted 68.3 % value.
    """
    order = Window.partitionBy(*keys).orderBy(y, w)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    at = F.sum(w).over(run) - F.col(w) * (1.0 - fraction)
    points = df.select(*keys, F.col(y).alias("y"), at.alias("at"), (fraction * F.sum(w).over(whole)).alias("target"), F.row_number().over(order).alias("k"), F.count("*").over(whole).alias("n"))
    order = Window.partitionBy(*keys).orderBy("k")
    points = points.select(*keys, "y", "at", "target", "k", "n", F.lag("y").over(order).alias("y0"), F.lag("at").over(order).alias("at0"))
    hit = points.filter((F.col("at") >= F.col("target") - F.lit(1e-12) * F.abs("target")) | (F.col("k") == F.col("n")))
    value = F.when(F.col("y0").isNull(), F.col("y")).otherwise(F.col("y0") + (F.col("target") - F.col("at0")) / (F.col("at") - F.col("at0")) * (F.col("y") - F.col("y0")))
    return hit.groupBy(*keys).agg(F.min_by(value, F.col("k")).alias(out))
