"""Gridding: local weighted polynomial surfaces at the pixels of a map.

Every class of surface is a set of weighted moment sums, which Spark adds up in parts before the shuffle by
pixel; only the small solve of each pixel's normal equations runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.spatial import LINES, in_boxes, inside_survey, range_join

#: Width in beams of the cells in which pixels meet footprints.
CELL_BEAMS = 8.0
#: Exponents of x and y of each term; 3, 6 and 10 terms are planes, quadratics and cubics.
TERMS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]


def pixel_grid(spark: SparkSession, x_range: tuple[float, float], y_range: tuple[float, float], step: float) -> DataFrame:
    """Pixels (x_pix, y_pix, x, y) from the low to the high bound, both included."""
    nx, ny = (int(round((b - a) / step)) + 1 for a, b in (x_range, y_range))
    return spark.range(nx * ny).select(
        (F.col("id") % nx).cast("int").alias("x_pix"),
        F.floor(F.col("id") / nx).cast("int").alias("y_pix"),
    ).select("*", (F.lit(x_range[0]) + F.col("x_pix") * step).alias("px"), (F.lit(y_range[0]) + F.col("y_pix") * step).alias("py"))


def kernel(distance: Column, beam: float, scale: Column | float) -> Column:
    """cos(pi d / 2 beam) to the power that makes it one half at scale * beam / 2."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    alpha = F.lit(float(np.log(0.5))) / F.log(F.cos(F.lit(np.pi / 4) * scale))
    return F.when(distance < beam, F.pow(F.greatest(F.cos(F.lit(np.pi / 2) * distance / beam), F.lit(1e-12)), alpha)).otherwise(0.0)


def scale_layer(weight_scale: float, gap: Column, beam: float) -> Column:
    """The kernel's scale at a place: the wanted one, or four thirds of the sampling gap, at most a beam."""
    return F.greatest(F.lit(weight_scale), F.least(gap * (4.0 / 3.0) / beam, F.lit(1.0)))


def gap_weight(distance: Column, gap: Column, beam: float) -> Column:
    """Weight of a sample's gap in the gap at a pixel: (-ln(d / beam)) to a power that depends on the gap."""
    power = F.lit(-2.329267) * F.log(gap / 2 / beam) - 0.510417
    return F.pow(-F.log(F.greatest(distance, F.lit(1e-6 * beam)) / beam), power)


def sampling_class(near: DataFrame, pixel: list[str], scan: str = "scan_id") -> DataFrame:
    """Terms the samples around each pixel can carry: 10, 6, 3 or 0.

    10 terms need 5 scans, 5 samples in one of them and 10 in all; 6 need 4, 4 and 6; 3 need 2, 2 and 3.
    """
    by_scan = near.groupBy(*pixel, scan).agg(F.count("*").alias("n"))
    sums = by_scan.groupBy(*pixel).agg(F.count("*").alias("scans"), F.max("n").alias("most"), F.sum("n").alias("total"))
    terms = F.lit(0)
    for k, scans, most, total in ((3, 2, 2, 3), (6, 4, 4, 6), (10, 5, 5, 10)):
        terms = F.when((F.col("scans") >= scans) & (F.col("most") >= most) & (F.col("total") >= total), k).otherwise(terms)
    return sums.withColumn("terms", terms)


def near_pixels(pixels: DataFrame, samples: DataFrame, beam: float, x: str, y: str) -> DataFrame:
    """Pixel and sample pairs closer than a beam, with dx, dy and distance."""
    near = range_join(pixels, samples, beam, ("px", "py"), (x, y))
    return near.withColumns({"dx": F.col(x) - F.col("px"), "dy": F.col(y) - F.col("py")})


def moments(near: DataFrame, pixel: list[str], z: str, w: Column, terms: int) -> DataFrame:
    """Weighted moment sums of each pixel: m_i_j for x^i y^j, and v_k for z times term k."""
    exponents = TERMS[:terms]
    wanted = sorted({(a + c, b + d) for a, b in exponents for c, d in exponents})
    power = lambda i, j: F.pow("dx", F.lit(i)) * F.pow("dy", F.lit(j))
    sums = [F.sum(F.col("w__") * power(i, j)).alias(f"m_{i}_{j}") for i, j in wanted]
    sums += [F.sum(F.col("w__") * F.col(z) * power(i, j)).alias(f"v_{k}") for k, (i, j) in enumerate(exponents)]
    return near.withColumn("w__", w).groupBy(*pixel).agg(*sums, F.count("*").alias("n"), F.sum("w__").alias("weight"))


def plane(near: DataFrame, pixel: list[str], z: str, w: Column) -> DataFrame:
    """Constant term of the weighted plane through each pixel's samples, by Cramer's rule; NULL where singular."""
    m = moments(near, pixel, z, w, 3)
    s, x, y, xx, xy, yy = (F.col(f"m_{i}_{j}") for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)))
    p, q, r = F.col("v_0"), F.col("v_1"), F.col("v_2")
    d = s * (xx * yy - xy * xy) - x * (x * yy - xy * y) + y * (x * xy - xx * y)
    c = p * (xx * yy - xy * xy) - x * (q * yy - xy * r) + y * (q * xy - xx * r)
    size = s * xx * yy
    return m.select(*pixel, "n", "weight", F.when(d > 1e-9 * size, c / d).alias("flux"))


def _solve(terms: int, pixel: list[str], keep: list[str], prior: bool):
    exponents = TERMS[:terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: np.asarray(b.column(c).to_numpy(zero_copy_only=False), dtype=float)  # noqa: E731, B023
            a = np.stack([[col(f"m_{i + k}_{j + m}") for k, m in exponents] for i, j in exponents]).transpose(2, 0, 1)
            v = np.stack([col(f"v_{k}") for k in range(terms)], axis=1)
            flux = _constant(a, v, b.column("terms").to_numpy(zero_copy_only=False))
            if prior:
                low = flux < 0
                again = a.copy()
                again[:, 0, 0] *= 2
                flux = np.where(low, _constant(again, v, b.column("terms").to_numpy(zero_copy_only=False)), flux)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*pixel, *keep]), pa.array(flux, pa.float64(), from_pandas=True)], [*pixel, *keep, "flux"])

    return run


def _constant(a: np.ndarray, v: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Constant term of each system, with as many terms as its class allows; NaN where it cannot be solved."""
    out = np.full(len(a), np.nan)
    for k in (3, 6, 10):
        rows = np.flatnonzero(terms == k)
        if len(rows) and k <= a.shape[1]:
            sub = a[rows, :k, :k]
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", sub), 1e-300))
            sub = sub / scale[:, :, None] / scale[:, None, :]
            good = np.linalg.cond(sub) < 1e12
            if good.any():
                found = np.linalg.solve(sub[good], (v[rows[good], :k] / scale[good])[..., None])[..., 0] / scale[good]
                out[rows[good]] = found[:, 0]
    return out


def surfaces(near: DataFrame, pixel: list[str], z: str, w: Column, noise_prior: bool = False, scan: str = "scan_id") -> DataFrame:
    """Flux of each pixel from the largest surface its samples carry (10, 6 or 3 terms; NULL for class 0).

    With the noise prior a negative flux is solved again with the sum of weights doubled.
    """
    sums = moments(near, pixel, z, w, 10)
    classed = sums.join(sampling_class(near, pixel, scan).select(*pixel, "terms"), pixel)
    kinds = ", ".join(f"{c} {classed.schema[c].dataType.simpleString()}" for c in [*pixel, "n", "weight", "terms"]) + ", flux double"
    return classed.mapInArrow(_solve(10, pixel, ["n", "weight", "terms"], noise_prior), kinds)


def layers(near: DataFrame, pixel: list[str], w: Column, gap: str | None = None, correlation: str | None = None, beam: float = 1.0, weight_scale: float = 1 / 3) -> DataFrame:
    """Weight, scale and correlation layers: summed weights, gap-driven kernel scale, and the weighted mean of
    the root of squared correlation over beams plus nine squared scales."""
    sums = [F.sum("w__").alias("weight"), F.sum(F.col("w__") * F.coalesce(F.col("dumps"), F.lit(1.0)) if "dumps" in near.columns else F.col("w__")).alias("weight2")]
    frame = near.withColumn("w__", w)
    if gap:
        g = gap_weight(F.col("distance"), F.col(gap), beam)
        sums.append((F.sum(g * F.col(gap)) / F.sum(g)).alias("gap"))
    if correlation:
        sums.append((F.sum(F.col("w__") * F.sqrt(F.pow(F.col(correlation) / beam, F.lit(2.0)) + 9.0 * weight_scale**2)) / F.sum("w__")).alias("correlation"))
    out = frame.groupBy(*pixel).agg(*sums)
    return out.withColumn("scale", scale_layer(weight_scale, F.col("gap"), beam)) if gap else out


def path_layer(samples: DataFrame, x: str, y: str, x0: float, y0: float, step: float) -> DataFrame:
    """The last scan that crosses each pixel: 1 for even scans, 0.5 for odd ones, with scan and sample number."""
    from starloom.functions.scalar import pixel_index

    last = samples.groupBy(pixel_index(F.col(x), x0, step).alias("x_pix"), pixel_index(F.col(y), y0, step).alias("y_pix")).agg(F.max(F.struct("scan_id", "sample_id")).alias("last"))
    return last.select("x_pix", "y_pix", F.when(F.col("last.scan_id") % 2 == 0, 1.0).otherwise(0.5).alias("path"), F.col("last.scan_id").alias("scan_id"), F.col("last.sample_id").alias("sample_id"))


def in_footprint(pixels: DataFrame, edges: DataFrame, beam: float, trim: float) -> DataFrame:
    """Pixels inside at least one survey: between a raster's edges in both axes, or within a daisy's radius less the trim.

    `edges` has a row a survey (map_type, x_low, x_high, y_low, y_high, cx, cy, radius, and the lines of
    geometry.with_lines, if a raster's edges are to be slanted, or the hull of geometry.with_hulls); its size is the number of surveys.
    """
    inside = inside_survey(F.col("px"), F.col("py"), trim * beam, LINES[0] in edges.columns, hull="hull" in edges.columns)
    # the box around each survey names the cells whose pixels are compared with it
    daisy = F.col("map_type") == "daisy"
    ends = {"a__": ("cx", "x_low", -1), "b__": ("cx", "x_high", 1), "c__": ("cy", "y_low", -1), "d__": ("cy", "y_high", 1)}
    boxes = edges.select("*", *[F.when(daisy, F.col(m) + k * F.greatest("radius", F.lit(0.0))).otherwise(F.col(e)).alias(n) for n, (m, e, k) in ends.items()])
    found = in_boxes(pixels, boxes.filter("a__ <= b__ and c__ <= d__"), "px", "py", ("a__", "b__", "c__", "d__"), CELL_BEAMS * beam)
    return found.filter(inside).select(*pixels.columns).distinct()


def brightest(pixels: DataFrame, flux: str = "flux", flag: str | None = None, order: list[str] = ("y_pix", "x_pix")) -> DataFrame:
    """The brightest pixel that is not flagged; ties go to the lowest indices."""
    open_ = pixels.filter(~F.col(flag)) if flag else pixels
    return open_.filter(F.col(flux).isNotNull()).orderBy(F.col(flux).desc(), *order).limit(1)
