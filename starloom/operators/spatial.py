"""Joins by place: bins, circles, boxes, and nearest samples of neighbouring scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scalar import sphere_distance


def bin_of(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def range_join(probe: DataFrame, build: DataFrame, radius: float, probe_xy: tuple[str, str], build_xy: tuple[str, str], distance: str = "flat", reach: int = 1, out: str = "distance") -> DataFrame:
    """Pairs of probe and build rows at most `radius` apart, with their distance.

    Both sides get the bins of a grid of radius / reach; the probe side is repeated for the bins around its own
    (3 by 3 at reach 1), so the join is an equi-join on bins with a residual filter, never a cross join. A crowded
    bin is a skewed key, which the adaptive skew join splits; a smaller bin (greater reach) splits it further.
    Columns of the two sides must have different names. `distance` is flat, sphere (degrees) or box.
    """
    size = radius / reach
    px, py, bx, by = F.col(probe_xy[0]), F.col(probe_xy[1]), F.col(build_xy[0]), F.col(build_xy[1])
    around = F.sequence(F.lit(-reach - (reach > 1)), F.lit(reach + (reach > 1)))
    spread = probe.select("*", F.explode(around).alias("dx__")).select("*", F.explode(around).alias("dy__"))
    spread = spread.select(*probe.columns, (bin_of(px, size) + F.col("dx__")).alias("px__"), (bin_of(py, size) + F.col("dy__")).alias("py__"))
    placed = build.select("*", bin_of(bx, size).alias("bx__"), bin_of(by, size).alias("by__"))
    joined = spread.join(placed, (F.col("px__") == F.col("bx__")) & (F.col("py__") == F.col("by__")))
    if distance == "box":
        joined = joined.filter((F.abs(px - bx) <= radius) & (F.abs(py - by) <= radius))
        measure = F.greatest(F.abs(px - bx), F.abs(py - by))
    elif distance == "sphere":
        measure = F.degrees(sphere_distance(py, px, by, bx))
    else:
        measure = F.sqrt((px - bx) * (px - bx) + (py - by) * (py - by))
    return joined.withColumn(out, measure).filter(F.col(out) <= radius).drop("px__", "py__", "bx__", "by__")


def radius_join(probe: DataFrame, build: DataFrame, radius: str, probe_xy: tuple[str, str], build_xy: tuple[str, str], out: str = "distance") -> DataFrame:
    """Pairs of probe and build rows at most the probe row's own `radius` apart, with their distance.

    Grids are nested: a probe row uses the one whose cells are as wide as the next power of two of its radius, so it asks for nine cells at most
    however large the radius; a build row is placed once in each grid in use. The join is an equi-join on grid and cell. Only the grids in use,
    a few powers of two, come to the driver. Rows without a radius or with a negative one match nothing; a radius of 0 matches equal places.
    """
    px, py, bx, by = F.col(probe_xy[0]), F.col(probe_xy[1]), F.col(build_xy[0]), F.col(build_xy[1])
    level = F.ceil(F.log2(F.greatest(F.col(radius), F.lit(2.0**-40)))).cast("int")
    asked = probe.filter(F.col(radius) >= 0).withColumn("grid__", level)
    grids = [r[0] for r in asked.select("grid__").distinct().collect()]
    cell = lambda x, grid: F.floor(x / F.pow(F.lit(2.0), grid))
    reach = lambda x: F.explode(F.sequence(cell(x - F.col(radius), F.col("grid__")), cell(x + F.col(radius), F.col("grid__"))))
    spread = asked.select("*", reach(px).alias("px__")).select("*", reach(py).alias("py__"))
    placed = build.select("*", F.explode(F.array(*(F.lit(g) for g in grids)).cast("array<int>")).alias("of__"))
    placed = placed.withColumns({"bx__": cell(bx, F.col("of__")), "by__": cell(by, F.col("of__"))})
    joined = spread.join(placed, (F.col("grid__") == F.col("of__")) & (F.col("px__") == F.col("bx__")) & (F.col("py__") == F.col("by__")))
    measure = F.sqrt((px - bx) * (px - bx) + (py - by) * (py - by))
    return joined.withColumn(out, measure).filter(F.col(out) <= F.col(radius)).drop("px__", "py__", "bx__", "by__", "grid__", "of__")


def in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, low_high: tuple[str, str, str, str], size: float) -> DataFrame:
    """Pairs of a point and a box (x low, x high, y low, y high) that holds it, ends included. A box is repeated for the
    grid cells of `size` that it meets, so the join is an equi-join on cells, and a large box spreads over many of them."""
    a, b, c, d = low_high
    cells = lambda low, high: F.explode(F.sequence(bin_of(F.col(low), size), bin_of(F.col(high), size)))
    placed = boxes.select("*", cells(a, b).alias("bx__")).select("*", cells(c, d).alias("by__"))
    near = points.select("*", bin_of(F.col(x), size).alias("px__"), bin_of(F.col(y), size).alias("py__"))
    j = near.join(placed, (F.col("px__") == F.col("bx__")) & (F.col("py__") == F.col("by__")))
    return j.filter(F.col(x).between(F.col(a), F.col(b)) & F.col(y).between(F.col(c), F.col(d))).drop("px__", "py__", "bx__", "by__")


#: Columns of the lines of a survey's footprint (geometry.with_lines).
LINES = [f"{edge}_{c}" for edge in ("low", "high", "first", "last") for c in ("at", "slope")]


def inside_survey(x: Column, y: Column, trim: float = 0.0, lines: bool = False, suffix: str = "", hull: bool = False) -> Column:
    """Whether a place lies in a survey's footprint (columns of geometry.footprint, with the suffix): within a daisy's
    radius less the trim, else strictly inside the box, or with `lines` between both lines along the scans' ends and
    between the first and the last scan. A line that could not be fitted does not count. With `hull` a survey of that map_type has the
    polygon in its column hull."""
    c = lambda name: F.col(name + suffix)
    box = (x > c("x_low")) & (x < c("x_high")) & (y > c("y_low")) & (y < c("y_high"))
    if lines:
        along, across = F.when(c("scans_in_ra"), x).otherwise(y), F.when(c("scans_in_ra"), y).otherwise(x)
        at = lambda edge, u: c(f"{edge}_at") + c(f"{edge}_slope") * u
        first, last = at("first", along), at("last", along)
        between = (F.coalesce(along > at("low", across), F.lit(True)), F.coalesce(along < at("high", across), F.lit(True)))
        crossed = F.coalesce((across > F.least(first, last)) & (across < F.greatest(first, last)) | first.isNull() | last.isNull(), F.lit(True))
        closed = x.between(c("x_low"), c("x_high")) & y.between(c("y_low"), c("y_high"))
        box = closed & between[0] & between[1] & crossed
    far = F.sqrt((x - c("cx")) * (x - c("cx")) + (y - c("cy")) * (y - c("cy")))
    shape = F.when(c("map_type") == "daisy", far < c("radius") - trim)
    if hull:
        shape = shape.when(c("map_type") == "hull", inside_hull(x, y, c("hull")))
    return shape.otherwise(box)


def inside_hull(x: Column, y: Column, hull: Column) -> Column:
    """Whether a place lies in a convex polygon (corners counter-clockwise, as geometry.convex_hulls has them), its border included; one of
    two corners is a stretch, one of one a point, one of none holds nothing."""
    ahead = F.concat(F.slice(hull, 2, F.size(hull)), F.slice(hull, 1, 1))
    left = lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0
    box = (x >= F.array_min(F.transform(hull, lambda p: p["x"]))) & (x <= F.array_max(F.transform(hull, lambda p: p["x"])))
    box &= (y >= F.array_min(F.transform(hull, lambda p: p["y"]))) & (y <= F.array_max(F.transform(hull, lambda p: p["y"])))
    return F.coalesce(box & F.forall(F.zip_with(hull, ahead, left), lambda ok: ok), F.lit(False))


def nearest_in_neighbours(samples: DataFrame, along: str, carry: list[str]) -> DataFrame:
    """For every sample the nearest one, by `along`, in the previous and in the next scan of its survey.

    A scan's samples and the places that its neighbours ask for form one stream in the order of `along`; two running
    windows give the nearest on both sides, so nothing is paired and a scan is shuffled three times as small rows.
    Ties go to the lower sample_id. Adds prev_<c> and next_<c> for each carried column; scans without a neighbour
    have NULLs.
    """
    keys = ["survey_id", "scan_id", "sample_id"]
    value = F.struct(*[F.col(c) for c in carry])
    build = samples.filter(F.col(along).isNotNull()).groupBy("survey_id", F.col("scan_id").cast("long").alias("at_scan"), F.col(along).alias("place"))
    build = build.agg(F.min("sample_id").alias("id__"), F.min_by(value, "sample_id").alias("v__"))
    none = lambda c: F.lit(None).cast(build.schema[c].dataType)
    sides = samples.select(*keys, F.col(along).alias("place"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    ask = sides.select("survey_id", (F.col("scan_id") + F.col("side")).cast("long").alias("at_scan"), "place", none("id__").alias("id__"), none("v__").alias("v__"), "scan_id", "sample_id", "side")
    stream = build.unionByName(ask, allowMissingColumns=True)
    w = Window.partitionBy("survey_id", "at_scan").orderBy("place", F.col("side").isNotNull())
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("side").isNull(), F.struct("place", "id__", "v__"))
    found = stream.select("*", F.last(own, True).over(before).alias("a__"), F.first(own, True).over(after).alias("b__")).filter("side is not null")
    da, db = F.abs(F.col("place") - F.col("a__.place")), F.abs(F.col("place") - F.col("b__.place"))
    second = F.col("a__").isNull() | (F.col("b__").isNotNull() & ((db < da) | (db == da) & (F.col("b__.id__") < F.col("a__.id__"))))
    best = found.select(*keys, "side", F.when(second, F.col("b__.v__")).otherwise(F.col("a__.v__")).alias("b"))
    named = best.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == k, F.col(f"b.{c}"))).alias(f"{side}_{c}") for k, side in ((-1, "prev"), (1, "next")) for c in carry])
    return samples.join(named, keys, "left")


def pair_counts(points: DataFrame, key: list[str], x: str, y: str, radius: Column | float) -> DataFrame:
    """Number of other points of the same key within the radius, by bins as wide as the radius."""
    a = points.select(*points.columns)
    b = points.select(*[F.col(c).alias(f"{c}_o") for c in points.columns])
    near = range_join(a, b, float(radius), (x, y), (f"{x}_o", f"{y}_o"))
    for k in key:
        near = near.filter(F.col(k) == F.col(f"{k}_o"))
    same = (F.col(x) == F.col(f"{x}_o")) & (F.col(y) == F.col(f"{y}_o"))
    return near.groupBy(*points.columns).agg(F.sum((~same).cast("long")).alias("n_near"))
