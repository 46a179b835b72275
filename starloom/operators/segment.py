"""Splitting and filtering of raw samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.grouped import SURVEYS, with_survey
from starloom.sources.tables import written

#: Columns of the telescope format whose negative values make a row unphysical.
PHYSICAL = ("DURATION", "EXPOSURE", "TSYS", "TCAL", "LST", "ELEVATIO", "TAMBIENT", "PRESSURE", "HUMIDITY", "RESTFREQ", "FREQRES", "TRGTLONG", "MJD", "UTSECS")


def split_raster(raw: DataFrame) -> DataFrame:
    """Adds segment (pre, scan, post) and scan_id to rows with survey_id, t, sweep, valid and cal_state.

    Valid sweeps are scans numbered by sweep; calibration rows before the first valid one are `pre`, those
    after the last are `post`; other rows between belong to no segment (null).
    """
    valid = F.col("valid") == 1
    ends = with_survey(raw, first__=F.min(F.when(valid, F.col("t"))), last__=F.max(F.when(valid, F.col("t"))))
    cal = F.col("cal_state") >= 0
    segment = F.when(valid, "scan").when(cal & (F.col("t") < F.col("first__")), "pre").when(cal & (F.col("t") > F.col("last__")), "post")
    return ends.withColumns({"segment": segment, "scan_id": F.when(valid, F.col("sweep"))}).drop("first__", "last__")


def split_daisy(raw: DataFrame, motion: DataFrame) -> DataFrame:
    """Cuts the single sweep of each daisy into petals, scans from one farthest point to the next; calibration rows are
    marked as in split_raster.

    motion (levelling.daisy_motion) has a row a survey; a petal takes half its period. A cut is the farthest sample
    of the stretch between half a petal before and after its expected time, the first of equal ones. A survey with a
    single petal, or without a period, is one scan.
    """
    from starloom.functions.scalar import flat_distance

    marked = split_raster(raw)
    ends = marked.filter("segment = 'scan'").groupBy("survey_id").agg(F.min("t").alias("t0__"), F.max("t").alias("t1__"))
    per = motion.select("survey_id", (F.col("period") / 2).alias("p__"), F.col("centre_ra").alias("x__"), F.col("centre_dec").alias("y__"))
    per = written(ends.join(per, "survey_id").withColumn("n__", F.coalesce(F.round((F.col("t1__") - F.col("t0__")) / F.nanvl("p__", F.lit(None))), F.lit(1)).cast("int")), "petals")
    j = marked.join(F.broadcast(per) if per.count() <= SURVEYS else per, "survey_id", "left")
    shrink = F.cos(F.radians("y__"))
    far = flat_distance(F.col("ra") * shrink, F.col("dec"), F.col("x__") * shrink, F.col("y__"))
    stretch = F.floor((F.col("t") - F.col("t0__")) / F.col("p__") + 0.5).cast("int")
    j = j.withColumns({"far__": far, "k__": F.when(F.col("segment") == "scan", F.when(F.col("n__") > 1, stretch).otherwise(0))})
    cuts = j.filter("k__ between 1 and n__ - 1").groupBy("survey_id", "k__").agg(F.max_by("t", F.struct("far__", -F.col("t"))).alias("cut__"))
    j = j.join(cuts, ["survey_id", "k__"], "left")
    petal = F.when(F.col("k__") < 1, 0).when(F.col("k__") >= F.col("n__"), F.col("n__") - 1).otherwise(F.col("k__") - 1 + (F.col("t") >= F.col("cut__")).cast("int"))
    return j.select(*[c for c in marked.columns if c != "scan_id"], F.when(F.col("segment") == "scan", petal).cast("int").alias("scan_id"))


def usable_scans(samples: DataFrame, keep_ends: bool = False) -> DataFrame:
    """Scans of at least two samples; the first and last segments hold calibration and go unless kept."""
    w = Window.partitionBy("survey_id", "scan_id")
    out = samples.withColumn("n__", F.count("*").over(w)).filter("n__ > 1").drop("n__")
    return out if keep_ends else out.filter("segment = 'scan'")


def composite_flux(samples: DataFrame) -> DataFrame:
    return samples.withColumn("flux_comp", (F.col("flux_l") + F.col("flux_r")) * 0.5)


def working_channel(samples: DataFrame, channel: str) -> DataFrame:
    source = {"left": "flux_l", "right": "flux_r", "composite": "flux_comp"}[channel]
    return samples.withColumn("flux", F.col(source))


def jansky_scale(samples: DataFrame, factor: float = 1.0, column: str = "flux") -> DataFrame:
    return samples.withColumn(column, F.col(column) * factor)


def gain_override(computed: Column, override: float | None) -> Column:
    """The override unless it is missing or within 1e-4 of -999."""
    return computed if override is None or abs(override + 999.0) < 1e-4 else F.lit(float(override))


def trim_turning_edges(samples: DataFrame, size: float, beam: float, turning: DataFrame) -> DataFrame:
    """Drops samples closer than size * beam to either turning point of their scan (turning: keys and ra_a, dec_a, ra_b, dec_b)."""
    from starloom.functions.scalar import flat_distance

    j = samples.join(turning, ["survey_id", "scan_id"])
    near = F.least(*(flat_distance(F.col("ra"), F.col("dec"), F.col(f"ra_{k}"), F.col(f"dec_{k}")) for k in "ab"))
    return j.filter(near >= size * beam).select(*samples.columns)


def apply_models(samples: DataFrame, models: DataFrame, value: str = "model") -> DataFrame:
    """Replaces flux by the sample's model; samples without one, or with NaN, go."""
    j = samples.join(models, ["survey_id", "scan_id", "sample_id"]).filter(F.col(value).isNotNull() & ~F.isnan(value))
    return j.withColumn("flux", F.col(value)).drop(value)


def subtract_background(samples: DataFrame, background: str = "background") -> DataFrame:
    """Takes the background off the flux and keeps it as large-scale data."""
    return samples.withColumns({"lss_data": F.col(background), "flux": F.col("flux") - F.col(background)})


def in_time_ranges(t: Column, include: list[tuple[float, float]], exclude: list[tuple[float, float]]) -> Column:
    """Inside any included range (all, if there is none) and outside every excluded one; strict limits."""
    ok = F.lit(not include)
    for a, b in include:
        ok = ok | ((t > a) & (t < b))
    for a, b in exclude:
        ok = ok & ~((t > a) & (t < b))
    return ok


def physical_rows(df: DataFrame, columns: tuple[str, ...] = PHYSICAL) -> DataFrame:
    """Rows without a negative value in those of the columns that are there; NULL passes."""
    ok = F.lit(True)
    for c in columns:
        if c in df.columns:
            ok = ok & F.coalesce(F.col(c) >= 0, F.lit(True))
    return df.filter(ok)


def parsable_times(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.try_to_timestamp(column).isNotNull())


def channel_count(df: DataFrame) -> DataFrame:
    """Number of distinct bands times polarisations."""
    return df.agg((F.countDistinct("if_num") * F.countDistinct("pol_num")).alias("n_channels"))


def validate_header(header: dict[str, str]) -> list[str]:
    """Raises on observations that cannot be mapped; returns warnings."""
    year, mode = int(header["DATE"].split("-")[0]), header["OBSMODE"].lower()
    if year <= 2014:
        raise ValueError(f"observations up to 2014 lack the columns needed: {header['DATE']}")
    if "track" in mode or "onoff" in mode:
        raise ValueError(f"not a mapping pattern: {header['OBSMODE']}")
    forced = header.get("COORDREF", "RA_DEC") not in ("RA_DEC", "LNG_LAT")
    return ["coordinates are forced to equatorial"] if forced else []


def corrected_frequency(frequency: float, year: int) -> float:
    """Before 2016 a header's 1550 MHz meant 1395 MHz."""
    return 1.395 if year < 2016 and abs(frequency - 1.55) < 1e-9 else frequency


def union_surveys(*surveys: DataFrame) -> DataFrame:
    """All surveys' samples, tagged by survey_id in their order."""
    out = surveys[0].withColumn("survey_id", F.lit(0))
    for i, s in enumerate(surveys[1:], 1):
        out = out.unionByName(s.withColumn("survey_id", F.lit(i)))
    return out
