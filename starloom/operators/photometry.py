"""Source detection and photometry on a pixel map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators import rcr
from starloom.operators.surface import brightest
from starloom.sources.tables import written


def centroid(near: DataFrame, keys: list[str], dx: str, dy: str, flux: str, weight: str) -> DataFrame:
    """keys, dx0, dy0: stationary point of the weighted quadratic through the samples around each place."""
    from starloom.operators.surface import TERMS

    renamed = near.withColumnsRenamed({dx: "dx", dy: "dy"})
    terms = TERMS[:6]
    wanted = sorted({(a + c, b + d) for a, b in terms for c, d in terms})
    power = lambda i, j: F.pow("dx", F.lit(i)) * F.pow("dy", F.lit(j))
    sums = renamed.groupBy(*keys).agg(*[F.sum(F.col(weight) * power(i, j)).alias(f"m_{i}_{j}") for i, j in wanted], *[F.sum(F.col(weight) * F.col(flux) * power(i, j)).alias(f"v_{k}") for k, (i, j) in enumerate(terms)])

    @F.pandas_udf("struct<dx0:double,dy0:double>")
    def solve(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        names = {c: i for i, c in enumerate(m.columns)}
        a = np.stack([[m.to_numpy(float)[:, names[f"m_{i + k}_{j + q}"]] for k, q in terms] for i, j in terms]).transpose(2, 0, 1)
        out = np.full((len(m), 2), np.nan)
        for r in range(len(m)):
            try:
                c = np.linalg.solve(a[r], v.to_numpy(float)[r])
                out[r] = np.linalg.solve([[2 * c[3], c[4]], [c[4], 2 * c[5]]], [-c[1], -c[2]])
            except np.linalg.LinAlgError:
                pass
        return pd.DataFrame(out, columns=["dx0", "dy0"])

    packed = solve(F.struct(*[f"m_{i}_{j}" for i, j in wanted]), F.struct(*[f"v_{k}" for k in range(6)]))
    return sums.select(*keys, packed.alias("c")).select(*keys, "c.dx0", "c.dy0")


def detect(samples: DataFrame, beam: float, limit: float = 75.0, least: int = 6, scatter: str = "scatter2d") -> DataFrame:
    """Sources of each survey, brightest first: samples of at least `limit` scatters that have `least` such samples of
    their survey within a beam and lie more than a beam from every brighter source.

    Equal fluxes: the lower scan and sample first. All surveys are decided at once, in rounds: a candidate brighter than all undecided ones
    within a beam is a source, and those within a beam of it go. Each round decides every local maximum, so there are as many rounds as
    the longest chain of ever brighter neighbours; no survey is one task's work. Each round's ids are written, as the next uses them twice.
    """
    from starloom.operators.spatial import range_join

    bright = samples.filter(F.col("flux") >= limit * F.col(scatter)).select("survey_id", "scan_id", "sample_id", "ra", "dec", "flux")
    bright = written(bright.withColumn("id__", F.monotonically_increasing_id()), "bright")
    other = bright.select(*[F.col(c).alias(f"{c}_o") for c in bright.columns])
    near = range_join(bright, other, beam, ("ra", "dec"), ("ra_o", "dec_o")).filter(F.col("survey_id").eqNullSafe(F.col("survey_id_o")))
    many = near.groupBy("id__").agg(F.count("*").alias("n_near")).filter(F.col("n_near") >= least)
    many = written(many, "candidates")
    first = F.struct(-F.col("flux"), "scan_id", "sample_id", "id__") < F.struct(-F.col("flux_o"), "scan_id_o", "sample_id_o", "id___o")
    pairs = near.filter(first).select(F.col("id__").alias("strong"), F.col("id___o").alias("weak"))
    for side in ("strong", "weak"):
        pairs = pairs.join(many.select(F.col("id__").alias(side)), side, "left_semi")
    pairs = written(pairs, "pairs")
    open_, sources = many.select("id__"), None
    while not open_.isEmpty():
        beaten = pairs.select(F.col("weak").alias("id__"))
        kept = written(open_.join(beaten, "id__", "left_anti"), "sources")
        sources = kept if sources is None else sources.unionByName(kept)
        gone = pairs.join(kept.withColumnRenamed("id__", "strong"), "strong", "left_semi").select(F.col("weak").alias("id__")).distinct()
        open_ = written(open_.join(kept, "id__", "left_anti").join(gone, "id__", "left_anti"), "undecided")
        left = open_.select(F.col("id__").alias("strong"))
        pairs = written(pairs.join(left, "strong", "left_semi").join(left.withColumnRenamed("strong", "weak"), "weak", "left_semi"), "pairs")
    found = bright.join(many, "id__")
    found = found.join(sources, "id__", "left_semi") if sources is not None else found
    order = Window.partitionBy("survey_id").orderBy(F.desc("flux"), "scan_id", "sample_id", "id__")
    return found.withColumn("source_id", (F.row_number().over(order) - 1).cast("int")).drop("id__")


def top_sources(pixels: DataFrame, k: int, radius: float) -> list[tuple[float, float, float]]:
    """(px, py, flux) of the k brightest places, each more than radius from those before; k passes over the map."""
    found: list[tuple[float, float, float]] = []
    rest = pixels
    for _ in range(k):
        row = brightest(rest).first()
        if row is None:
            break
        found.append((row["px"], row["py"], row["flux"]))
        far = (F.col("px") - row["px"]) ** 2 + (F.col("py") - row["py"]) ** 2 > radius**2
        rest = rest.filter(far)
    return found


def centred_sources(pixels: DataFrame, sources: DataFrame, radius: float, beam: float, kernel_scale: float = 1.0, rounds: int = 5) -> DataFrame:
    """Sources moved, `rounds` times, to the stationary point of the weighted quadratic through the map around them.

    The kernel is as wide as the beam: with the map's own narrow one a first place half a beam away is lost. A step that would leave the radius around
    the first place, or none, leaves a source where it is. Each round's few rows are written, as the next one uses them twice.
    """
    from starloom.operators.surface import kernel

    known = pixels.filter(F.col("flux").isNotNull() & ~F.isnan("flux")).select("px", "py", "flux")
    sources = sources.select("source_id", "sx", "sy", F.col("sx").alias("sx0__"), F.col("sy").alias("sy0__"))
    for _ in range(rounds):
        near = _around(known, sources, min(radius, beam)).withColumns({"dx": F.col("px") - F.col("sx"), "dy": F.col("py") - F.col("sy"), "w__": kernel(F.col("distance"), beam, kernel_scale)})
        step = centroid(near, ["source_id"], "dx", "dy", "flux", "w__").withColumnRenamed("source_id", "s__")
        sound = F.coalesce(F.sqrt((F.col("sx") + F.col("dx0") - F.col("sx0__")) ** 2 + (F.col("sy") + F.col("dy0") - F.col("sy0__")) ** 2) <= radius, F.lit(False))
        moved = sources.join(step, F.col("source_id") == F.col("s__"), "left")
        sources = written(moved.select("source_id", "sx0__", "sy0__", *[(F.col(c) + F.when(sound, F.col(d)).otherwise(0.0)).alias(c) for c, d in (("sx", "dx0"), ("sy", "dy0"))]), "places")
    return sources.select("source_id", "sx", "sy")


def annulus(pixels: DataFrame, sources: DataFrame, inner: float, outer: float) -> DataFrame:
    """source_id, mu, sigma, mu_error and n of the background ring around each source, after robust rejection."""
    j = _around(pixels, sources, outer).filter(F.col("distance") >= inner)
    r = rcr.by_group(j, ["source_id"], "flux", "weight", "ES_MODE_DL")
    return r.select("source_id", "mu", F.col("stdev_above").alias("sigma"), (F.col("stdev") / F.sqrt("n_kept")).alias("mu_error"), "n_kept")


def aperture(pixels: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """source_id, n_pixels, flux_sum, peak and ratio_sum (sum of correlated pixels over weight) inside the radius."""
    j = _around(pixels, sources, radius)
    ratio = F.sum(F.lit(1.0) / F.col("weight")) if "n_correlated" not in pixels.columns else F.sum(F.col("n_correlated") / F.col("weight"))
    return j.groupBy("source_id").agg(F.count("*").alias("n_pixels"), F.sum("flux").alias("flux_sum"), F.max("flux").alias("peak"), F.avg("weight").alias("mean_weight"), ratio.alias("ratio_sum"))


def _around(pixels: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    from starloom.operators.spatial import range_join

    return range_join(sources.select("source_id", "sx", "sy"), pixels, radius, ("sx", "sy"), ("px", "py"))


def correction(peak: Column, peak_radius: float, inner: float, sigma: Column, rfi: float, weight: float, pixel: float) -> tuple[Column, Column]:
    """Factor of the flux and its uncertainty, for what interference removal takes from a source: from the peak's height
    over the background noise, the radius of the aperture and the scales of the job, all in beams."""
    # Published fit of the loss to simulated sources.
    size = min(2 * inner, 2.5) / 2.5
    height = peak / ((1.13309 - 1.13309 * float(np.exp(-2.77259 * peak_radius**2))) / pixel**2)
    scales = rfi ** (2.64 * size**-0.54) + 0.34 * size**0.73 * weight ** (1.66 * size**-0.18)
    ratio = height / (1000.0 * sigma)
    loss = 0.22 * size**0.52 * F.pow(ratio, F.lit(-1.20 * size**-0.39)) * scales
    spread = 0.082 * size**0.32 * F.pow(ratio, F.lit(-1.35 * size**-0.08)) * scales
    factor = 1.0 + F.pow(F.pow(loss, F.lit(-0.82)) + 0.052 * size**-0.11 * scales**-0.29, F.lit(-1.22))
    return factor, F.pow(F.pow(spread, F.lit(-0.82)) + 0.065 * size**-0.02 * scales**-0.29, F.lit(-1.22))


def photometry(pixels: DataFrame, sources: DataFrame, inner: float, outer: float, beam: float = 1.0, rfi: float = 0.7, weight: float = 1 / 3, pixel: float = 0.05) -> DataFrame:
    """A row a source: place, background mu, sigma and its error, aperture pixels and error, measured and corrected flux,
    and internal, external and total error (as many fields as a full report has). The radii are in the map's unit, the
    job's scales (rfi, weight, pixel) in beams. The measured flux is the aperture's sum less the background's share;
    the corrected one is times the factor of `correction`, whose uncertainty gives the external error; the
    internal error counts twice in the total. A source whose peak does not rise above the background keeps its flux."""
    a, b = aperture(pixels, sources, inner), annulus(pixels, sources, inner, outer)
    peak_radius = min(inner / beam, 0.7)
    inside = _around(pixels, sources, peak_radius * beam).groupBy(F.col("source_id").alias("s__")).agg(F.sum("flux").alias("peak_sum"), F.count("flux").alias("peak_n"))
    j = sources.join(a, "source_id").join(b, "source_id").join(inside, F.col("source_id") == F.col("s__"), "left")
    measured = F.col("flux_sum") - F.col("n_pixels") * F.col("mu")
    error = F.col("sigma") * F.sqrt(F.col("mean_weight") * F.col("ratio_sum"))
    internal = F.sqrt(error**2 + (F.col("n_pixels") * F.col("mu_error")) ** 2)
    peak = F.col("peak_sum") - F.col("peak_n") * F.col("mu")
    factor, spread = correction(peak, peak_radius, inner / beam, F.col("sigma"), rfi, weight, pixel)
    sound = (peak > 0) & (F.col("sigma") > 0) & F.lit(rfi > 0)
    outside = F.abs(measured) * F.when(sound, spread).otherwise(0.0)
    return j.select(
        "source_id", F.col("sx").alias("ra_pix"), F.col("sy").alias("dec_pix"), "mu", "sigma", F.col("mu_error").alias("mu_uncertainty"), F.col("n_pixels").alias("aperture_pixels"), error.alias("aperture_sigma"),
        measured.alias("measured"), internal.alias("internal_error"), (measured * F.when(sound, factor).otherwise(1.0)).alias("corrected"), outside.alias("external_error"), F.sqrt((2 * internal) ** 2 + outside**2).alias("total_error"),
    )
