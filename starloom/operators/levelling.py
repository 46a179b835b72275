"""Offsets between overlapping surveys, and cleaning of spectra: stages that are optional in a job."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators import background, rcr
from starloom.operators.grouped import SURVEYS, summarised, with_survey
from starloom.operators.spatial import inside_survey, range_join
from starloom.sources.tables import written


#: Pairs of overlapping surveys whose differences (24 bytes each) come to the driver at most, after they were counted.
MOST_PAIRS = 5_000_000


def survey_differences(samples: DataFrame, beam: float, flux: str = "flux", footprints: DataFrame | None = None) -> DataFrame:
    """survey_a, survey_b, mu, sigma, n: robust mean, over the samples of a, of a's flux less b's weighted mean around
    the sample; only where b has three samples within half a beam and, with footprints (geometry.footprint), the sample
    lies inside b's. Surveys that do not overlap have no row."""
    a = samples.select(F.col("survey_id").alias("survey_a"), "scan_id", "sample_id", F.col("ra").alias("ax"), F.col("dec").alias("ay"), F.col(flux).alias("az"))
    b = samples.select(F.col("survey_id").alias("survey_b"), F.col("ra").alias("bx"), F.col("dec").alias("by"), F.col(flux).alias("bz"))
    near = range_join(a, b, beam / 2, ("ax", "ay"), ("bx", "by")).filter("survey_a <> survey_b")
    w = F.pow(F.cos(F.lit(np.pi) * F.col("distance") / beam), F.lit(2.0)) + 1e-9
    local = near.withColumn("w", w).groupBy("survey_a", "survey_b", "scan_id", "sample_id", "ax", "ay", "az").agg((F.sum(F.col("w") * F.col("bz")) / F.sum("w")).alias("z"), F.count("*").alias("n")).filter("n >= 3")
    if footprints is not None:
        edges = written(footprints.select(*(F.col(c).alias(f"{c}__") for c in footprints.columns)), "edges")
        side = F.broadcast(edges) if edges.count() <= SURVEYS else edges
        local = local.join(side, F.col("survey_b") == F.col("survey_id__")).filter(inside_survey(F.col("ax"), F.col("ay"), suffix="__"))
    r = rcr.by_group(local.select("survey_a", "survey_b", (F.col("az") - F.col("z")).alias("d")), ["survey_a", "survey_b"], "d", None, "LS_MODE_DL")
    return r.select("survey_a", "survey_b", "mu", F.col("stdev").alias("sigma"), F.col("n_kept").alias("n"))


def _least_squares(a: np.ndarray, b: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """x of least norm that makes the weighted squares of x[a] - x[b] - d smallest, by conjugate gradients on the graph of pairs."""
    apply = lambda x: np.bincount(a, w * (x[a] - x[b]), n) - np.bincount(b, w * (x[a] - x[b]), n)
    r = np.bincount(a, w * d, n) - np.bincount(b, w * d, n)
    x, p, size = np.zeros(n), r.copy(), float(r @ r)
    goal = 1e-26 * size
    for _ in range(20 * n + 100):
        if size <= goal:
            break
        q = apply(p)
        step = size / float(p @ q)
        x += step * p
        r -= step * q
        size, before = float(r @ r), size
        p = r + size / before * p
    return x


def survey_offsets(differences: DataFrame) -> DataFrame:
    """survey_id and offset: the least-squares offset of each survey, of mean zero in each group of overlapping surveys."""
    rows = written(differences.filter("mu is not null and not isnan(mu)"), "differences")
    if rows.count() > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of surveys overlap")
    pairs = rows.select("survey_a", "survey_b", "mu", (F.col("n") / F.pow(F.greatest(F.coalesce(F.nanvl("sigma", F.lit(0.0)), F.lit(0.0)), F.lit(1e-9)), F.lit(2.0))).alias("w")).toArrow()
    a, b, d, w = (np.asarray(pairs[c]) for c in ("survey_a", "survey_b", "mu", "w"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    # the scale of the weights does not matter, their ratios do
    x = _least_squares(at[: len(a)], at[len(a) :], d.astype(float), w / w.max(), len(ids)) if len(a) else np.zeros(0)
    return differences.sparkSession.createDataFrame(pa.table({"survey_id": pa.array(ids, pa.int32()), "offset": pa.array(x, pa.float64())}))


def level(samples: DataFrame, beam: float, flux: str = "flux", footprints: DataFrame | None = None) -> DataFrame:
    """samples with each survey's offset taken off; surveys without overlap stay as they are."""
    offsets = survey_offsets(survey_differences(samples, beam, flux, footprints)).withColumnRenamed("survey_id", "survey__")
    side = F.broadcast(offsets) if offsets.count() <= SURVEYS else offsets
    moved = samples.join(side, F.col("survey_id") == F.col("survey__"), "left")
    return moved.withColumn(flux, F.col(flux) - F.coalesce(F.col("offset"), F.lit(0.0))).drop("survey__", "offset")


def clean_spectra(spectra: DataFrame, length: float, key: str = "row_id", data: str = "data") -> DataFrame:
    """key, data and baseline: every spectrum with its slow baseline over channels taken off. The noise of a spectrum
    is the robust spread of its point-to-point residuals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, values in zip(pdf[key], pdf[data]):
            y = np.asarray(values, float)
            x, w = np.arange(len(y), dtype=float), np.ones(len(y))
            noise = 0.8197 * rcr.reject(y, w, "SS_MEDIAN_DL", True, rcr.neighbour_residuals(x, y)).stdev if len(y) > 3 else 0.0
            base = background.scan_background(x, y, w, noise, length)
            out.append((k, (y - base).tolist(), base.tolist()))
        return pd.DataFrame(out, columns=[key, "data", "baseline"])

    kind = spectra.schema[key].dataType.simpleString()
    return spectra.select(key, data).mapInPandas(lambda it: (run(p) for p in it), f"{key} {kind}, data array<double>, baseline array<double>")


#: Bins of a daisy's time; a survey's distances are averaged in them before anything is shuffled.
TIME_BINS = 1 << 16


def daisy_motion(samples: DataFrame) -> DataFrame:
    """survey_id, centre_ra, centre_dec, period and radius of a daisy: the middle of its places, the period of the distance from it, and the largest distance.

    Extents are aggregates; distances are averaged in at most TIME_BINS bins of each survey's time, partially before their
    shuffle, so however many samples a survey has, its period comes from that many rows. Bins follow the number of samples
    where there are fewer."""
    from starloom.operators.timeshift import period

    s = with_survey(samples.select("survey_id", "t", "ra", "dec"), a__=F.min("ra"), b__=F.max("ra"), c__=F.min("dec"), d__=F.max("dec"), t0__=F.min("t"), t1__=F.max("t"), n__=F.count("*"))
    x, y = (F.col("a__") + F.col("b__")) / 2, (F.col("c__") + F.col("d__")) / 2
    far = F.sqrt(F.pow((F.col("ra") - x) * F.cos(F.radians(y)), F.lit(2.0)) + F.pow(F.col("dec") - y, F.lit(2.0)))
    bins = F.least(F.greatest(F.col("n__") * 4, F.lit(8)), F.lit(TIME_BINS))
    bin_ = F.when(F.col("t1__") > F.col("t0__"), F.least(F.floor((F.col("t") - F.col("t0__")) / (F.col("t1__") - F.col("t0__")) * bins), bins - 1)).otherwise(F.lit(0))
    each = s.select("survey_id", x.alias("centre_ra"), y.alias("centre_dec"), far.alias("r"), "t", bin_.alias("bin")).groupBy("survey_id", "centre_ra", "centre_dec", "bin").agg(F.avg("t").alias("t"), F.avg("r").alias("r"), F.max("r").alias("most"))

    def run(t: np.ndarray, r: np.ndarray, most: np.ndarray) -> tuple:
        return (2 * period(t, r) if len(t) > 1 else None, float(most.max()))

    found = summarised(each, ["survey_id", "centre_ra", "centre_dec"], ["t", "r", "most"], "period double, radius double", run, ["t"])
    return found.select("survey_id", "centre_ra", "centre_dec", "period", "radius")
