"""Operators that depend on the order of samples inside a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scalar import sphere_distance

SCAN = ["survey_id", "scan_id"]


def in_scan(order: str = "sample_id") -> Window:
    return Window.partitionBy(*SCAN).orderBy(order)


def path_length(samples: DataFrame, ra: str = "ra", dec: str = "dec", out: str = "ang_dist") -> DataFrame:
    """Adds the angular distance travelled since the scan's first sample, in degrees."""
    w = in_scan()
    step = F.degrees(sphere_distance(F.col(dec), F.col(ra), F.lag(dec).over(w), F.lag(ra).over(w)))
    stepped = samples.withColumn("step__", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn(out, F.sum("step__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step__")


def point_residual(samples: DataFrame, x: str, y: str, out: str = "residual") -> DataFrame:
    """Adds y less the line through the neighbours on both sides; ends use their two nearest neighbours."""
    w = in_scan()

    def at(c: str, k: int) -> Column:
        return F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)

    def line(i: int, j: int) -> Column:
        xi, yi = (F.lag(x, -i).over(w), F.lag(y, -i).over(w)) if i < 0 else (F.lead(x, i).over(w), F.lead(y, i).over(w))
        xj, yj = (F.lag(x, -j).over(w), F.lag(y, -j).over(w)) if j < 0 else (F.lead(x, j).over(w), F.lead(y, j).over(w))
        return yi + F.try_divide(yj - yi, xj - xi) * (F.col(x) - xi)

    return samples.withColumn(out, F.col(y) - F.coalesce(line(-1, 1), line(1, 2), line(-2, -1)))


def sticky_unwrap(df: DataFrame, keys: list[str], order: str, value: str, period: float, out: str) -> DataFrame:
    """Adds value with `period` added from the first decrease of more than half a period on."""
    w = Window.partitionBy(*keys).orderBy(order)
    crossed = (F.lag(value).over(w) - F.col(value) > period / 2).cast("int")
    marked = df.withColumn("crossed__", F.coalesce(crossed, F.lit(0)))
    since = F.max("crossed__").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(out, F.col(value) + period * since).drop("crossed__")


def cross_repair(df: DataFrame, keys: list[str], order: str, value: str, period: float, out: str) -> DataFrame:
    """Adds value with `period` taken off before the last crossing instead."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("crossed__", F.coalesce((F.lead(value).over(w) - F.col(value) < -period / 2).cast("int"), F.lit(0)))
    ahead = F.max("crossed__").over(w.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn(out, F.col(value) - period * ahead).drop("crossed__")


def speed(samples: DataFrame, x: str, t: str = "t", out: str = "speed") -> DataFrame:
    """Adds the backward difference quotient of x by t."""
    w = in_scan()
    return samples.withColumn(out, F.try_divide(F.col(x) - F.lag(x).over(w), F.col(t) - F.lag(t).over(w)))


def shift_asof(samples: DataFrame, values: list[str], shift: float | Column, t: str = "t", suffix: str = "_shifted") -> DataFrame:
    """Adds each value at time t + shift (a number, or a column of the samples): linear between the samples on both sides, and the end value beyond.

    Both the samples and the wanted times form one ordered stream a scan, so the bracketing join is two
    running windows over one shuffle by scan.
    """
    own = samples.select(*SCAN, "sample_id", F.col(t).alias("at__"), F.lit(0).alias("wanted__"), *[F.col(v).alias(f"{v}__") for v in values])
    ask = samples.select(*SCAN, "sample_id", (F.col(t) + shift).alias("at__"), F.lit(1).alias("wanted__"), *[F.lit(None).cast("double").alias(f"{v}__") for v in values])
    w = Window.partitionBy(*SCAN).orderBy("at__", "wanted__", "sample_id")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    time = F.when(F.col("wanted__") == 0, F.col("at__"))
    t0, t1 = F.last(time, ignorenulls=True).over(before), F.first(time, ignorenulls=True).over(after)
    columns = []
    for v in values:
        v0, v1 = F.last(f"{v}__", ignorenulls=True).over(before), F.first(f"{v}__", ignorenulls=True).over(after)
        between = v0 + F.coalesce(F.try_divide(F.col("at__") - t0, t1 - t0), F.lit(0.0)) * (v1 - v0)
        columns.append(F.coalesce(between, v0, v1).alias(v + suffix))
    found = own.unionByName(ask).select(*SCAN, "sample_id", "wanted__", *columns).filter("wanted__ = 1").drop("wanted__")
    return samples.join(found, [*SCAN, "sample_id"])


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds value with NULLs filled linearly by `order` between known neighbours, and by the nearest at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = F.when(F.col(value).isNotNull(), F.col(order))
    x0, x1 = F.last(x, True).over(before), F.first(x, True).over(after)
    v0, v1 = F.last(value, True).over(before), F.first(value, True).over(after)
    between = v0 + F.coalesce(F.try_divide(F.col(order) - x0, x1 - x0), F.lit(0.0)) * (v1 - v0)
    return df.withColumn(out, F.coalesce(between, v0, v1))


def daisy_radius(samples: DataFrame, distance: str, centre: str = "center_idx", out: str = "radius") -> DataFrame:
    """Adds the signed distance from the centre: negative before a petal's centre sample, with sides alternating by scan."""
    side = F.when(F.col("sample_id") < F.col(centre), -1.0).otherwise(1.0) * F.when(F.col("scan_id") % 2 == 0, 1.0).otherwise(-1.0)
    return samples.withColumn(out, side * F.col(distance))
