"""The mapping job: samples of one or more surveys to pixels, stage by stage, and photometry.

Every stage is a function from DataFrame to DataFrame. Bounds, grids and gains are small aggregates that
come to the driver (a row a survey); samples never do. Written tables cut the lineage where a stage's result
is used more than once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import background, calibrate, geometry, levelling, local_surface, neighbourhood, ordered, photometry, segment, spectral, surface, timeshift
from starloom.operators.grouped import SURVEYS
from starloom.plans.config import Job
from starloom.sources.tables import written


def integrate(spectra: DataFrame, job: Job) -> DataFrame:
    """Samples from spectra; a band's flux is the sum of its channels.

    Rows of one frequency are pairs, right in even rows and left in odd ones. Where the first two of four rows differ in
    frequency, the four are one sample of two receivers: right ones first, then left ones; the job's receiver takes the
    higher or the lower frequency.
    """
    n = F.size("data")
    # channels that were not read keep the others at their frequencies
    first, whole = (F.coalesce(F.col(c), d) if c in spectra.columns else d for c, d in (("first_channel", F.lit(0)), ("channels", n)))
    axis = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.col("obs_freq") + (j + first + 1 - whole / 2) * F.col("cdelt") / 1e6)
    bands = list(job.include) or [(float("-inf"), float("inf"))]
    flux = spectral.band_integral(F.col("data"), axis, bands, list(job.exclude))
    keep = ["survey_id", "t", "ra", "dec", "az", "el", "dumps", "cal_state", "sweep", "valid"]
    at = F.pmod(F.col("row_id"), F.lit(4))
    row = F.struct("total", "obs_freq", *keep)
    fours = spectra.withColumn("total", flux).groupBy("path", F.floor(F.col("row_id") / 4).alias("four")).agg(*[F.max(F.when(at == k, row)).alias(f"r{k}") for k in range(4)])
    quad = F.coalesce(F.col("r0.obs_freq") != F.col("r1.obs_freq"), F.lit(False))
    first_is_high = F.col("r0.obs_freq") > F.col("r1.obs_freq")
    mine = first_is_high if job.receiver == "hi" else ~first_is_high
    own = lambda i: F.struct(*[F.coalesce(F.col(f"r{i}.{c}"), F.col(f"r{i + 1}.{c}")).alias(c) for c in keep])
    sample = lambda row_id, right, left, kept: F.struct(row_id.alias("row_id"), right.alias("flux_r"), left.alias("flux_l"), kept.alias("kept"))
    total = lambda i: F.col(f"r{i}.total")
    one = sample(F.col("four"), F.when(mine, total(0)).otherwise(total(1)), F.when(mine, total(2)).otherwise(total(3)), own(0))
    two = [sample(F.col("four") * 2 + i // 2, total(i), total(i + 1), own(i)) for i in (0, 2)]
    there = F.filter(F.array(*two), lambda s: s["kept"]["survey_id"].isNotNull())
    return fours.select("path", F.explode(F.when(quad, F.array(one)).otherwise(there)).alias("s")).select("path", "s.row_id", "s.flux_r", "s.flux_l", "s.kept.*")


def scans(raw: DataFrame, job: Job) -> DataFrame:
    """Calibrated samples of usable scans, numbered in time, with the working channel as flux; hours become degrees.

    Each channel is calibrated by its own noise signal, then both are averaged, if both are wanted. A daisy is cut into
    petals; the declinations of drift scans are smoothed.
    """
    raw = raw.withColumn("ra", F.col("ra") * 15)
    if job.pattern == "daisy":
        raw = written(raw, "daisy")
        split = segment.split_daisy(raw, levelling.daisy_motion(raw.filter("valid = 1")))
    else:
        split = segment.split_raster(raw)
    split = split.filter("segment is not null")
    if job.calibration != "none":
        split = written(split, "split")
        for channel in {"left": ["flux_l"], "right": ["flux_r"], "composite": ["flux_l", "flux_r"]}[job.channel]:
            deltas = calibrate.overridden(calibrate.gain_deltas(split, channel), split, job.gain_start, job.gain_end)
            split = calibrate.apply_gain(split, written(deltas, "gains"), job.calibration, channel)
    out = segment.working_channel(segment.composite_flux(split), job.channel)
    order = F.row_number().over(ordered.in_scan("t")) - 1
    numbered = segment.usable_scans(out).withColumn("sample_id", order)
    numbered = numbered.withColumn("scan_id", F.col("scan_id").cast("int"))
    return geometry.smoothed_declination(numbered) if job.pattern == "drift" else numbered


def across_petals(samples: DataFrame) -> DataFrame:
    """Daisies with center_idx, the sample of each petal nearest to the centre, and radius, the signed distance from it."""
    motion = levelling.daisy_motion(samples)
    j = samples.join(motion.select("survey_id", "centre_ra", "centre_dec"), "survey_id")
    far = j.withColumn("far__", F.sqrt((F.col("ra") - F.col("centre_ra")) ** 2 + (F.col("dec") - F.col("centre_dec")) ** 2))
    centres = far.groupBy("survey_id", "scan_id").agg(F.min_by("sample_id", F.struct("far__", "sample_id")).alias("center_idx"))
    return ordered.daisy_radius(far.join(centres, ["survey_id", "scan_id"]), "far__").drop("far__", "centre_ra", "centre_dec")


def prepare(samples: DataFrame, job: Job, beam: float, centre: tuple[float, float]) -> DataFrame:
    """Background taken off and scans aligned in time; adds ang_dist and both scatters. Places are on the plane around the centre."""
    s = written(geometry.on_plane(ordered.path_length(samples), centre), "scans")
    along = "ang_dist"
    if job.pattern == "daisy":
        s, along = written(across_petals(s), "petals"), "radius"
    noise = written(calibrate.smooth_scatter(calibrate.scan_scatter(s)), "scatter")
    s = s.join(noise.select("survey_id", "scan_id", F.col("scatter_model").alias("scatter")), ["survey_id", "scan_id"])
    if job.background_scale and not job.skip_background:
        s = segment.subtract_background(background.background(s, job.background_scale * beam))
    else:
        s = s.withColumn("lss_data", F.col("flux"))
    s = written(s, "flat")
    if job.time_shift != "off" and not job.skip_time_shift:
        if job.time_shift == "custom":
            s = shifted(s, job.time_shift_value)
        else:
            speeds = ordered.speed(s, "ang_dist").groupBy("survey_id").agg(F.median("speed").alias("speed"))
            found = timeshift.survey_shift(timeshift.consistent_lags(timeshift.adjacent_lags(s, along if along == "radius" else "ra")), speeds)
            per = written(found.select(F.col("survey_id").alias("survey__"), "t_shift"), "shifts")
            timed = s.join(F.broadcast(per) if per.count() <= SURVEYS else per, F.col("survey_id") == F.col("survey__"), "left").drop("survey__")
            # a survey without a shift keeps its places: shifted by 0 they are its own
            s = shifted(timed.withColumn("t_shift", F.coalesce(F.nanvl("t_shift", F.lit(0.0)), F.lit(0.0))), F.col("t_shift")).drop("t_shift")
    plane = calibrate.plane_scatter(s, noise.select("survey_id", "scan_id", "scatter", "clean_dumps"), along)
    return written(s.join(plane, ["survey_id", "scan_id"]), "prepared")


def smoothed(samples: DataFrame, job: Job, beam: float) -> DataFrame:
    """Prepared samples with the smooth surface through the large-scale data around each as flux; its noise replaces scatter2d."""
    length = job.background_scale or 3.0
    along = "radius" if job.pattern == "daisy" else "ang_dist"
    noise = calibrate.large_scale_scatter(samples, along).select("survey_id", "scan_id", F.col("lss_scatter2d").alias("scatter2d"), "elevation_scatter")
    s = samples.drop("scatter2d").join(noise, ["survey_id", "scan_id"])
    gaps = neighbourhood.sampling_gap(s, beam).withColumn("theta_gap", F.degrees("theta_gap"))
    s = written(s.join(gaps, ["survey_id", "scan_id", "sample_id"]).withColumn("reach", local_surface.search_radius(beam, length)), "wide")
    made = local_surface.local_surfaces(s, max(length / 3, 1.0) * beam, "reach", flux="lss_data")
    surface_ = made.select("survey_id", "scan_id", "sample_id", "surface")
    return written(s.drop("flux", "theta_gap", "reach").join(surface_, ["survey_id", "scan_id", "sample_id"]).withColumnRenamed("surface", "flux"), "smooth")


def levelled(samples: DataFrame, job: Job, beam: float, flux: str) -> DataFrame:
    """Prepared samples with the offsets of overlapping surveys taken off, if the job levels them."""
    return written(levelling.level(samples, beam, flux, geometry.footprint(samples, "daisy" if job.pattern == "daisy" else "raster")), "level") if job.level else samples


def shifted(samples: DataFrame, shift: float | Column) -> DataFrame:
    moved = ordered.shift_asof(samples, ["ra", "dec"], shift)
    return moved.withColumns({"ra": F.col("ra_shifted"), "dec": F.col("dec_shifted")}).drop("ra_shifted", "dec_shifted")


def bright_places(samples: DataFrame, job: Job, beam: float) -> DataFrame | None:
    """Places of more models around detected sources, where the surveys' smallest gap is narrow enough for them."""
    least = geometry.gap_threshold(samples, centre="center_idx" if job.pattern == "daisy" else None).agg(F.min("gap")).first()[0]
    if not least or not (least / beam) ** 0.5 < job.rfi_scale < 1:
        return None
    sources = photometry.detect(samples.withColumn("survey_id", F.lit(0)), beam, job.detect_limit).select("ra", "dec")
    return written(neighbourhood.extra_models(sources, beam, job.rfi_scale, least).select("mx", "my").distinct(), "extra")


def map_pixels(samples: DataFrame, job: Job, beam: float, centre: tuple[float, float]) -> DataFrame:
    """Pixels of all layers from prepared samples: interference off, gaps measured, surfaces fitted.

    px and py are places on the plane around the centre; ra and dec (or galactic longitude and latitude) are the sky's.
    """
    spark = samples.sparkSession
    if job.trim:
        samples = segment.trim_turning_edges(samples, job.trim, beam, geometry.turning_points(samples))
    if job.coordinates == "galactic":
        sky = written(geometry.to_galactic(geometry.on_plane(samples, centre, undo=True)), "galactic")
        centre = geometry.middle(sky) or centre
        samples = geometry.on_plane(sky, centre)
    if job.rfi_scale and not job.skip_rfi:
        extra = bright_places(samples, job, beam) if job.extra_models else None
        models = neighbourhood.interference_models(samples, job.rfi_scale * beam, extra=extra)
        samples = samples.join(models, ["survey_id", "scan_id", "sample_id"]).filter(~F.isnan("model")).withColumn("flux", F.col("model")).drop("model")
    else:
        samples = samples.withColumns({"gm_weight": F.lit(1.0), "correlation": F.lit(1.0)})
    samples = written(samples, "clean")
    daisy = job.pattern == "daisy"
    edges = geometry.footprint(samples, "daisy" if daisy else "raster")
    directions = written(geometry.scan_direction(samples), "directions")
    turned = samples.join(directions, "survey_id")
    edges = written(geometry.with_lines(edges, geometry.edge_lines(turned, F.col("scans_in_ra")), directions), "edges")
    if job.pattern == "nodding":
        # up and down strokes meet in no common line, so their hull is the map's border
        edges = written(geometry.with_hulls(edges, samples), "hulls")
    least = geometry.gap_threshold(samples, centre="center_idx" if daisy else None)
    gaps = neighbourhood.sampling_gap(geometry.least_gap(samples, edges, least), beam, "min_gap")
    samples = written(samples.join(gaps, ["survey_id", "scan_id", "sample_id"]).withColumn("theta_gap", F.degrees("theta_gap")), "gapped")
    b = geometry.robust_bounds(samples)
    step = job.pixel_scale * beam
    grid = surface.pixel_grid(spark, (b[0], b[1]), (b[2], b[3]), step)
    pixel = ["x_pix", "y_pix", "px", "py"]
    near = written(surface.near_pixels(surface.in_footprint(grid, edges, beam, job.trim), samples, beam, "ra", "dec"), "near")
    k = surface.kernel(F.col("distance"), beam, job.weight_scale)
    fitted = surface.surfaces(near, pixel, "flux", k * F.col("gm_weight"), job.noise_prior)
    layered = surface.layers(near, pixel, k * F.col("gm_weight"), "theta_gap", "correlation", beam, job.weight_scale)
    out = fitted.drop("weight").join(layered, pixel)
    path = surface.path_layer(samples, "ra", "dec", b[0], b[2], step).select("x_pix", "y_pix", "path")
    out = out.join(path, ["x_pix", "y_pix"], "left").withColumns({"ra": F.col("px"), "dec": F.col("py")})
    return geometry.on_plane(out, centre, undo=True)


def source_table(pixels: DataFrame, job: Job, beam: float, samples: DataFrame | None = None) -> DataFrame:
    """Photometry of sources of a map: the brightest ones, the one in the map's middle, those at the job's places, or all that are detected in
    the prepared samples of all surveys together, each moved to its centroid. At most as many rows as the job names come to the driver, detected
    ones none; a place is taken to its nearest pixel."""
    spark = pixels.sparkSession
    if job.centroid == "detected":
        found = photometry.detect(samples.withColumn("survey_id", F.lit(0)), beam, job.detect_limit)
        return _measured(pixels, found.select("source_id", F.col("ra").alias("sx"), F.col("dec").alias("sy")), job, beam)
    if job.centroid == "brightest":
        found = [(x, y) for x, y, _ in photometry.top_sources(pixels, job.sources, job.outer_radius * beam)]
    elif job.centroid == "center":
        m = pixels.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
        found = [] if m[0] is None else [((m[0] + m[1]) / 2, (m[2] + m[3]) / 2)]
    else:
        far = lambda a, d: (F.col("ra") - a) ** 2 + (F.col("dec") - d) ** 2
        near = pixels.agg(*[F.min_by(F.struct("px", "py"), F.struct(far(a, d), "y_pix", "x_pix")).alias(f"p{i}") for i, (a, d) in enumerate(job.places)]).first()
        found = [(p["px"], p["py"]) for p in near if p is not None]
    sources = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(found)], "source_id int, sx double, sy double")
    return _measured(pixels, sources, job, beam)


def _measured(pixels: DataFrame, sources: DataFrame, job: Job, beam: float) -> DataFrame:
    sources = photometry.centred_sources(pixels, sources, job.inner_radius * beam, beam)
    return photometry.photometry(pixels, sources, job.inner_radius * beam, job.outer_radius * beam, beam, 0.0 if job.skip_rfi else job.rfi_scale, job.weight_scale, job.pixel_scale)


def run(spark: SparkSession, raw: DataFrame, job: Job, beam: float) -> dict[str, DataFrame]:
    """All products of a job: map, and raw_map, large_scale and sources if asked for. raw has readers.SAMPLES and survey_id."""
    samples = written(scans(raw, job), "samples")
    centre = geometry.middle(samples)
    if centre is None:
        raise ValueError("no usable scans")
    prepared = levelled(prepare(samples, job, beam, centre), job, beam, "lss_data")
    out = {"map": written(map_pixels(prepared, job, beam, centre), "map")}
    plain = replace(job, background_scale=0.0, rfi_scale=0.0, time_shift="off")
    if job.raw_map:
        out["raw_map"] = map_pixels(levelled(prepare(samples, plain, beam, centre), job, beam, "flux"), plain, beam, centre)
    if job.large_scale:
        wide = smoothed(prepared, job, beam) if job.smooth_large_scale else prepared.withColumn("flux", F.col("lss_data"))
        out["large_scale"] = map_pixels(wide, plain, beam, centre)
    if job.photometry:
        out["sources"] = source_table(out["map"], job, beam, prepared)
    return out
