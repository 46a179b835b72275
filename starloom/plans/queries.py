"""The query catalogue over the driver's tables (see sources.adapter for what stands for what)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions import moments, scalar
from starloom.operators import background, calibrate, geometry, neighbourhood, ordered, photometry, rcr, segment, spatial, spectral, surface, timeshift
from starloom.operators.grouped import summarised
from starloom.plans.catalogue import ORACLES, QUERIES, query
from starloom.sources.adapter import EVENT_SAMPLES, SCATTER_POINTS, event_samples, scatter_points, spectra, table

__all__ = ["ORACLES", "QUERIES"]


def r6(c: Column | str) -> Column:
    """Rounded for comparison; -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


S = f"WITH {EVENT_SAMPLES} "
P = f"WITH {SCATTER_POINTS} "
GC = "degrees(acos(greatest(-1.0, least(1.0, sin(radians({d1}))*sin(radians({d2})) + cos(radians({d1}))*cos(radians({d2}))*cos(radians({r1} - {r2}))))))"


# scans, bounds and ordered operators


@query("scan_bounds", S + "SELECT scan_id, count(*) AS n, round(min(ra),6) AS ra_min, round(max(ra),6) AS ra_max, round(min(dec),6) AS dec_min, round(max(dec),6) AS dec_max FROM samples GROUP BY scan_id")
def scan_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = geometry.scan_bounds(event_samples(spark, d))
    return b.select("scan_id", "n", *[r6(c).alias(c) for c in ("ra_min", "ra_max", "dec_min", "dec_max")])


@query(
    "grid_shape",
    S + "SELECT survey_id, greatest(1, floor((max(ra)-min(ra))*least(cos(radians(min(dec))),cos(radians(max(dec))))/0.2))::INT AS n_ra, greatest(1, floor((max(dec)-min(dec))/0.2))::INT AS n_dec FROM samples GROUP BY survey_id",
)
def grid_shape(spark: SparkSession, d: str) -> DataFrame:
    b = event_samples(spark, d).groupBy("survey_id").agg(F.min("ra").alias("ra_min"), F.max("ra").alias("ra_max"), F.min("dec").alias("dec_min"), F.max("dec").alias("dec_max"))
    return geometry.grid_shape(b, 0.2, 0.7).select("survey_id", "n_ra", "n_dec")


@query(
    "cumulative_path",
    S + ", s AS (SELECT *, lag(ra) OVER w AS r0, lag(dec) OVER w AS d0 FROM samples WINDOW w AS (PARTITION BY scan_id ORDER BY sample_id))"
    + f" SELECT scan_id, sample_id, round(sum(coalesce({GC.format(d1='dec', d2='d0', r1='ra', r2='r0')}, 0)) OVER (PARTITION BY scan_id ORDER BY sample_id), 6) + 0.0 AS ang_dist FROM s",
)
def cumulative_path(spark: SparkSession, d: str) -> DataFrame:
    return ordered.path_length(event_samples(spark, d)).select("scan_id", "sample_id", r6("ang_dist").alias("ang_dist"))


@query(
    "point_to_point_residual",
    S + """SELECT scan_id, sample_id, round(flux - coalesce(
      lag(flux) OVER w + (lead(flux) OVER w - lag(flux) OVER w) / nullif(lead(t) OVER w - lag(t) OVER w, 0) * (t - lag(t) OVER w),
      lead(flux) OVER w + (lead(flux, 2) OVER w - lead(flux) OVER w) / nullif(lead(t, 2) OVER w - lead(t) OVER w, 0) * (t - lead(t) OVER w),
      lag(flux, 2) OVER w + (lag(flux) OVER w - lag(flux, 2) OVER w) / nullif(lag(t) OVER w - lag(t, 2) OVER w, 0) * (t - lag(t, 2) OVER w)), 4) + 0.0 AS residual
    FROM samples WINDOW w AS (PARTITION BY scan_id ORDER BY sample_id)""",
)
def point_to_point_residual(spark: SparkSession, d: str) -> DataFrame:
    return ordered.point_residual(event_samples(spark, d), "t", "flux").select("scan_id", "sample_id", (F.round("residual", 4) + 0.0).alias("residual"))


@query(
    "sticky_unwrap",
    S + ", c AS (SELECT scan_id, sample_id, t % 86400 AS day, CASE WHEN lag(t % 86400) OVER w - t % 86400 > 43200 THEN 1 ELSE 0 END AS x FROM samples WINDOW w AS (PARTITION BY scan_id ORDER BY sample_id))"
    " SELECT scan_id, sample_id, round(day + 86400.0 * max(x) OVER (PARTITION BY scan_id ORDER BY sample_id), 4) AS unwrapped FROM c",
)
def sticky_unwrap(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d).withColumn("day", F.col("t") % 86400.0)
    return ordered.sticky_unwrap(s, ["scan_id"], "sample_id", "day", 86400.0, "unwrapped").select("scan_id", "sample_id", F.round("unwrapped", 4).alias("unwrapped"))


@query("scan_speed", S + "SELECT scan_id, sample_id, round((dec - lag(dec) OVER w) / nullif(t - lag(t) OVER w, 0) * 1e6, 4) + 0.0 AS speed FROM samples WINDOW w AS (PARTITION BY scan_id ORDER BY sample_id)")
def scan_speed(spark: SparkSession, d: str) -> DataFrame:
    return ordered.speed(event_samples(spark, d), "dec").select("scan_id", "sample_id", (F.round(F.col("speed") * 1e6, 4) + 0.0).alias("speed"))


@query(
    "asof_time_shift",
    S + """, ask AS (SELECT scan_id, sample_id, t + 3600.0 AS tt FROM samples),
    lo AS (SELECT a.scan_id, a.sample_id, a.tt, s.t AS t0, s.dec AS v0 FROM ask a ASOF LEFT JOIN samples s ON a.scan_id = s.scan_id AND a.tt >= s.t),
    hi AS (SELECT a.scan_id, a.sample_id, s.t AS t1, s.dec AS v1 FROM ask a ASOF LEFT JOIN samples s ON a.scan_id = s.scan_id AND a.tt <= s.t)
    SELECT scan_id, sample_id, round(coalesce(v0 + coalesce((tt - t0) / nullif(t1 - t0, 0), 0) * (v1 - v0), v0, v1), 6) AS dec_shifted FROM lo JOIN hi USING (scan_id, sample_id)""",
)
def asof_time_shift(spark: SparkSession, d: str) -> DataFrame:
    return ordered.shift_asof(event_samples(spark, d), ["dec"], 3600.0).select("scan_id", "sample_id", r6("dec_shifted").alias("dec_shifted"))


@query(
    "gap_fill",
    S + """, g AS (SELECT scan_id, sample_id, CASE WHEN state <> 'error' THEN flux END AS v FROM samples),
    b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN sample_id END IGNORE NULLS) OVER p AS x0, last_value(v IGNORE NULLS) OVER p AS v0,
      first_value(CASE WHEN v IS NOT NULL THEN sample_id END IGNORE NULLS) OVER n AS x1, first_value(v IGNORE NULLS) OVER n AS v1 FROM g
      WINDOW p AS (PARTITION BY scan_id ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY scan_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT scan_id, sample_id, round(coalesce(v0 + coalesce((sample_id - x0)::DOUBLE / nullif(x1 - x0, 0), 0) * (v1 - v0), v0, v1), 6) AS filled FROM b""",
)
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d).withColumn("v", F.when(F.col("state") != "error", F.col("flux")))
    return ordered.fill_gaps(s, ["scan_id"], "sample_id", "v", "filled").select("scan_id", "sample_id", r6("filled").alias("filled"))


@query(
    "neighbour_shift_filter",
    S + """, l AS (SELECT survey_id, scan_id, avg(flux) AS lag FROM samples GROUP BY ALL),
    r AS (SELECT *, least(abs(lag - lag(lag) OVER w) / nullif(max(lag) OVER () - min(lag) OVER (), 0), 1) AS a, least(abs(lag - lead(lag) OVER w) / nullif(max(lag) OVER () - min(lag) OVER (), 0), 1) AS b, count(*) OVER () AS n FROM l WINDOW w AS (PARTITION BY survey_id ORDER BY scan_id))
    SELECT scan_id, ((a IS NULL AND b IS NULL) OR pow(2, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT - 1) * coalesce(a*(2-a), 1) * coalesce(b*(2-b), 1) <= 1.0/(2.0*n)) AS kept FROM r""",
)
def neighbour_shift_filter(spark: SparkSession, d: str) -> DataFrame:
    lags = event_samples(spark, d).groupBy("survey_id", "scan_id").agg(F.avg("flux").alias("lag"))
    return timeshift.consistent_lags(lags).select("scan_id", "kept")


@query(
    "inter_scan_gaps",
    S + """, m AS (SELECT scan_id, median(ra) AS ra, median(dec) AS dec FROM samples GROUP BY scan_id),
    st AS (SELECT scan_id, abs(dec - lag(dec) OVER (PARTITION BY scan_id ORDER BY sample_id)) AS step FROM samples),
    i AS (SELECT scan_id, median(step) AS intra FROM st GROUP BY scan_id)
    SELECT scan_id, round(intra, 6) AS intra_gap, round(sqrt(pow(ra - lead(ra) OVER (ORDER BY scan_id), 2) + pow(dec - lead(dec) OVER (ORDER BY scan_id), 2)), 6) AS inter_gap FROM m JOIN i USING (scan_id)""",
)
def inter_scan_gaps(spark: SparkSession, d: str) -> DataFrame:
    return geometry.scan_gaps(event_samples(spark, d), "dec").select("scan_id", r6("intra_gap").alias("intra_gap"), r6("inter_gap").alias("inter_gap"))


@query(
    "turning_points",
    S + "SELECT scan_id, round(arg_min(ra, sample_id), 6) AS ra_a, round(arg_min(dec, sample_id), 6) AS dec_a, round(arg_max(ra, sample_id), 6) AS ra_b, round(arg_max(dec, sample_id), 6) AS dec_b FROM samples GROUP BY scan_id",
)
def turning_points(spark: SparkSession, d: str) -> DataFrame:
    return geometry.turning_points(event_samples(spark, d)).select("scan_id", *[r6(c).alias(c) for c in ("ra_a", "dec_a", "ra_b", "dec_b")])


# statistics


@query("weighted_mean", S + "SELECT scan_id, round(sum(dumps*flux)/sum(dumps), 6) AS mu FROM samples GROUP BY scan_id")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).groupBy("scan_id").agg(r6(moments.weighted_mean(F.col("flux"), F.col("dumps"))).alias("mu"))


def _rank_sql(fraction: float, out: str) -> str:
    return S + f""", p AS (SELECT scan_id, flux AS y, sum(dumps) OVER (PARTITION BY scan_id ORDER BY flux, dumps ROWS UNBOUNDED PRECEDING) - dumps * (1 - {fraction}) AS reach,
      {fraction} * sum(dumps) OVER (PARTITION BY scan_id) AS target, row_number() OVER (PARTITION BY scan_id ORDER BY flux, dumps) AS k FROM samples),
    q AS (SELECT *, lag(y) OVER (PARTITION BY scan_id ORDER BY k) AS y0, lag(reach) OVER (PARTITION BY scan_id ORDER BY k) AS reach0 FROM p),
    h AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY k) AS first FROM q WHERE reach >= target - 1e-12 * abs(target))
    SELECT scan_id, round(CASE WHEN y0 IS NULL THEN y ELSE y0 + (target - reach0) / (reach - reach0) * (y - y0) END, 6) AS {out} FROM h WHERE first = 1"""


@query("weighted_median", _rank_sql(0.5, "med"))
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return moments.interpolated_rank(event_samples(spark, d), ["scan_id"], "flux", "dumps", 0.5, "med").select("scan_id", r6("med").alias("med"))


@query("sigma68", _rank_sql(0.682689, "s68"))
def sigma68(spark: SparkSession, d: str) -> DataFrame:
    return moments.interpolated_rank(event_samples(spark, d), ["scan_id"], "flux", "dumps", 0.682689, "s68").select("scan_id", r6("s68").alias("s68"))


@query("unweighted_median", S + "SELECT scan_id, round(median(flux), 6) AS med FROM samples GROUP BY scan_id")
def unweighted_median(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).groupBy("scan_id").agg(r6(F.median("flux")).alias("med"))


@query(
    "reliability_stdev",
    S + ", m AS (SELECT scan_id, dumps, flux - sum(dumps*flux) OVER (PARTITION BY scan_id) / sum(dumps) OVER (PARTITION BY scan_id) AS y FROM samples) SELECT scan_id, round(sqrt(sum(dumps*y*y)/(sum(dumps)-sum(dumps*dumps)/sum(dumps))), 6) AS sd FROM m GROUP BY scan_id",
)
def reliability_stdev(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scan_id")
    y = F.col("flux") - F.sum(F.col("dumps") * F.col("flux")).over(w) / F.sum("dumps").over(w)
    return event_samples(spark, d).withColumn("y", y).groupBy("scan_id").agg(r6(moments.reliability_stdev(F.col("y"), F.col("dumps"))).alias("sd"))


@query(
    "weighted_line",
    S + """, c AS (SELECT *, sample_id::DOUBLE AS x FROM samples), a AS (SELECT scan_id, sum(dumps) s, sum(dumps*x) sx, sum(dumps*flux) sy, sum(dumps*x*x) sxx, sum(dumps*x*flux) sxy FROM c GROUP BY scan_id)
    SELECT scan_id, round((sy - (s*sxy-sx*sy)/(s*sxx-sx*sx)*sx)/s, 6) AS intercept, round((s*sxy-sx*sy)/(s*sxx-sx*sx), 6) + 0.0 AS slope FROM a""",
)
def weighted_line(spark: SparkSession, d: str) -> DataFrame:
    i, s = moments.weighted_line(F.col("sample_id").cast("double"), F.col("flux"), F.col("dumps"))
    return event_samples(spark, d).groupBy("scan_id").agg(r6(i).alias("intercept"), r6(s).alias("slope"))


@query("anchored_line", S + "SELECT scan_id, round(sum(dumps*sample_id*flux)/sum(dumps*sample_id*sample_id), 6) AS slope FROM samples GROUP BY scan_id")
def anchored_line(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).groupBy("scan_id").agg(r6(moments.anchored_line(F.col("sample_id").cast("double"), F.col("flux"), F.col("dumps"))).alias("slope"))


# spectra

E_ = "embedding::DOUBLE[]"


@query("channel_slice_reverse", "SELECT vec_id AS row_id, round(embedding[20]::DOUBLE, 6) + 0.0 AS first, round(embedding[5]::DOUBLE, 6) + 0.0 AS last, len(list_reverse(embedding[5:20])) AS n FROM embeddings")
def channel_slice_reverse(spark: SparkSession, d: str) -> DataFrame:
    c = spectral.channel_range(F.col("data"), 5, 20)
    return spectra(spark, d).select("row_id", r6(c[0]).alias("first"), r6(F.element_at(c, -1)).alias("last"), F.size(c).cast("bigint").alias("n"))


@query(
    "band_integral",
    "SELECT vec_id AS row_id, round(coalesce(list_sum(list_transform(list_filter(range(64), lambda j: 1000.0+j*2.0 > 1010 AND 1000.0+j*2.0 < 1100 AND NOT (1000.0+j*2.0 >= 1030 AND 1000.0+j*2.0 <= 1040)), lambda j: embedding[j+1]::DOUBLE)), 0), 6) + 0.0 AS total FROM embeddings",
)
def band_integral(spark: SparkSession, d: str) -> DataFrame:
    f = F.transform(F.sequence(F.lit(0), F.size("data") - 1), lambda j: 1000.0 + j * 2.0)
    return spectra(spark, d).select("row_id", r6(spectral.band_integral(F.col("data"), f, (1010, 1100), [(1030, 1040)])).alias("total"))


@query("continuum", f"SELECT vec_id AS row_id, round(list_sum({E_}), 6) + 0.0 AS total FROM embeddings")
def continuum(spark: SparkSession, d: str) -> DataFrame:
    return spectra(spark, d).select("row_id", r6(spectral.continuum(F.col("data"))).alias("total"))


@query("channel_spectrum_sum", f"SELECT label AS if_num, (j - 1)::INT AS channel, round(sum(v), 5) + 0.0 AS total FROM (SELECT label, unnest({E_}) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings) GROUP BY ALL")
def channel_spectrum_sum(spark: SparkSession, d: str) -> DataFrame:
    return spectral.channel_sums(spectra(spark, d), ["if_num"]).select("if_num", F.col("channel").cast("int").alias("channel"), (F.round("total", 5) + 0.0).alias("total"))


@query("frequency_ranges", f"SELECT vec_id AS row_id, len(k) AS n, round(coalesce(list_sum(k), 0), 6) + 0.0 AS total FROM (SELECT vec_id, list_transform(list_filter(range(64), lambda j: (j > 5 AND j < 30 OR j > 40 AND j < 60) AND NOT (j > 10 AND j < 20)), lambda j: embedding[j+1]::DOUBLE) AS k FROM embeddings)")
def frequency_ranges(spark: SparkSession, d: str) -> DataFrame:
    f = F.sequence(F.lit(0), F.size("data") - 1)
    k = spectral.in_frequency_ranges(F.col("data"), f, [(5, 30), (40, 60)], [(10, 20)])
    return spectra(spark, d).select("row_id", F.size(k).cast("bigint").alias("n"), r6(spectral.continuum(k)).alias("total"))


@query("polarisation_pivot", f"SELECT floor(vec_id/2)::BIGINT AS pair_id, min(vec_id) AS row_id, round(max(CASE WHEN vec_id % 2 = 0 THEN list_sum({E_}) END), 6) + 0.0 AS flux_right, round(max(CASE WHEN vec_id % 2 = 1 THEN list_sum({E_}) END), 6) + 0.0 AS flux_left FROM embeddings GROUP BY 1")
def polarisation_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).withColumn("total", spectral.continuum(F.col("data")))
    out = spectral.deinterleave(s, "row_id", "total", ["flux_right", "flux_left"], ["row_id"])
    return out.select("pair_id", "row_id", r6("flux_right").alias("flux_right"), r6("flux_left").alias("flux_left"))


@query("quad_pivot", f"SELECT floor(vec_id/4)::BIGINT AS pair_id, round(max(CASE WHEN vec_id % 4 = 0 THEN list_sum({E_}) END), 6) + 0.0 AS flux_right, round(max(CASE WHEN vec_id % 4 = 2 THEN list_sum({E_}) END), 6) + 0.0 AS flux_left FROM embeddings GROUP BY 1")
def quad_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).withColumn("total", spectral.continuum(F.col("data")))
    out = spectral.deinterleave(s, "row_id", "total", ["flux_right", "", "flux_left", ""], ["row_id"])
    return out.select("pair_id", r6("flux_right").alias("flux_right"), r6("flux_left").alias("flux_left"))


@query("dropout_refill", """WITH k AS (SELECT vec_id, j - 1 AS channel, v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings WHERE vec_id < 100000000)),
  b AS (SELECT vec_id, channel, last_value(CASE WHEN v >= 0 THEN channel END IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN v >= 0 THEN v END IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v >= 0 THEN channel END IGNORE NULLS) OVER n AS x1, first_value(CASE WHEN v >= 0 THEN v END IGNORE NULLS) OVER n AS v1 FROM k
   WINDOW p AS (PARTITION BY vec_id ORDER BY channel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY vec_id ORDER BY channel ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT vec_id AS row_id, channel::INT AS channel, round(coalesce(v0 + coalesce((channel - x0)::DOUBLE / nullif(x1 - x0, 0), 0) * (v1 - v0), v0, v1), 6) AS filled FROM b""")
def dropout_refill(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d)
    s = s.select("row_id", F.size("data").alias("n"), spectral.excise_dropouts(F.col("data"), {}).alias("kept"))
    s = s.withColumn("kept", F.transform("kept", lambda x: F.struct(x.getField("flux").alias("flux"), x.getField("index").alias("index"))))
    return spectral.refill_dropouts(s, "row_id", "kept", "n", "filled").select("row_id", F.col("channel").cast("int").alias("channel"), r6("filled").alias("filled"))


# filters and scalar functions


@query("time_ranges", S + "SELECT scan_id, sample_id FROM samples WHERE (t % 86400 > 3600 AND t % 86400 < 40000 OR t % 86400 > 50000 AND t % 86400 < 80000) AND NOT (t % 86400 > 10000 AND t % 86400 < 20000)")
def time_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d)
    return s.filter(segment.in_time_ranges(F.col("t") % 86400.0, [(3600, 40000), (50000, 80000)], [(10000, 20000)])).select("scan_id", "sample_id")


@query("physical_value_filter", "SELECT c_custkey AS row_id FROM customer WHERE c_acctbal >= 0")
def physical_value_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("TSYS"))
    return segment.physical_rows(c).select("row_id")


@query("band_selection", "SELECT count(DISTINCT label) * count(DISTINCT vec_id % 2) AS n_channels FROM embeddings")
def band_selection(spark: SparkSession, d: str) -> DataFrame:
    return segment.channel_count(spectra(spark, d).withColumn("pol_num", F.col("row_id") % 2))


@query(
    "to_galactic",
    S + """SELECT scan_id, sample_id, round(degrees(asin(greatest(-1.0, least(1.0, sin(radians(27.1284))*sin(radians(dec)) + cos(radians(27.1284))*cos(radians(dec))*cos(radians(ra-192.8595)))))), 6) AS b,
    round(((122.932 - degrees(atan2(cos(radians(dec))*sin(radians(ra-192.8595)), cos(radians(27.1284))*sin(radians(dec)) - sin(radians(27.1284))*cos(radians(dec))*cos(radians(ra-192.8595)))) + 720) % 360), 6) AS l FROM samples""",
)
def to_galactic(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).select("scan_id", "sample_id", r6(scalar.galactic_b(F.col("ra"), F.col("dec"))).alias("b"), r6(scalar.galactic_l(F.col("ra"), F.col("dec"))).alias("l"))


@query("frame_round_trip", S + "SELECT scan_id, sample_id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM samples")
def frame_round_trip(spark: SparkSession, d: str) -> DataFrame:
    there = geometry.to_galactic(event_samples(spark, d), branch="branch")
    return geometry.to_equatorial(there, branch="branch").select("scan_id", "sample_id", r6("ra").alias("ra"), r6("dec").alias("dec"))


@query("great_circle", S + f"SELECT scan_id, sample_id, round({GC.format(d1='dec', d2='20.0', r1='ra', r2='101.0')}, 6) AS distance FROM samples")
def great_circle(spark: SparkSession, d: str) -> DataFrame:
    dist = F.degrees(scalar.sphere_distance(F.col("dec"), F.col("ra"), F.lit(20.0), F.lit(101.0)))
    return event_samples(spark, d).select("scan_id", "sample_id", r6(dist).alias("distance"))


@query("pixel_index", S + "SELECT scan_id, sample_id, round((ra - 100.013) * (1.0/0.07))::INT AS x_pix, round((dec - 20.007) * (1.0/0.07))::INT AS y_pix FROM samples")
def pixel_index(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).select("scan_id", "sample_id", scalar.pixel_index(F.col("ra"), 100.013, 0.07).alias("x_pix"), scalar.pixel_index(F.col("dec"), 20.007, 0.07).alias("y_pix"))


@query("signed_angle", S + "SELECT scan_id, sample_id, round(CASE WHEN ra = 102.4 AND dec = 21.5 THEN 0.0 ELSE (atan2(dec - 21.5, ra - 102.4) + 4*pi()) % (2*pi()) END, 6) AS angle FROM samples")
def signed_angle(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).select("scan_id", "sample_id", r6(scalar.signed_arc_tan(F.col("dec") - 21.5, F.col("ra") - 102.4)).alias("angle"))


@query("tail_probability", S + "SELECT scan_id, sample_id, round(pow(1 + (flux/100/sqrt(2.0))*(0.0705230784 + (flux/100/sqrt(2.0))*(0.0422820123 + (flux/100/sqrt(2.0))*(0.0092705272 + (flux/100/sqrt(2.0))*(0.0001520143 + (flux/100/sqrt(2.0))*(0.0002765672 + 0.0000430638*(flux/100/sqrt(2.0))))))), -16), 9) AS p FROM samples")
def tail_probability(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(spark, d).select("scan_id", "sample_id", F.round(scalar.erfc_normal(F.col("flux") / 100), 9).alias("p"))


@query("gain_interpolated", S + "SELECT scan_id, sample_id, round(flux / (2.0 + (3.0 - 2.0) / (1706572800.0 - 1704067200.0) * (t - 1704067200.0)), 6) AS flux FROM samples")
def gain_interpolated(spark: SparkSession, d: str) -> DataFrame:
    deltas = spark.createDataFrame([(0, "pre", 2.0, 1704067200.0), (0, "post", 3.0, 1706572800.0)], "survey_id int, segment string, delta double, t double")
    return calibrate.apply_gain(event_samples(spark, d), deltas).select("scan_id", "sample_id", r6("flux").alias("flux"))


@query("union_surveys", "SELECT survey_id, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 0 AS survey_id, c_acctbal AS v FROM customer UNION ALL SELECT 1, s_acctbal FROM supplier) GROUP BY 1")
def union_surveys(spark: SparkSession, d: str) -> DataFrame:
    both = segment.union_surveys(table(spark, d, "customer").select(F.col("c_acctbal").alias("v")), table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")))
    return both.groupBy("survey_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("scan_split", S + ", b AS (SELECT min(t) FILTER (state IN ('view','purchase')) AS a, max(t) FILTER (state IN ('view','purchase')) AS z FROM samples) SELECT event AS event_id, seg AS segment, scan AS scan_id FROM (SELECT scan_id * 1000 + sample_id AS event, CASE WHEN state IN ('view','purchase') THEN 'scan' WHEN state = 'signup' AND t < a THEN 'pre' WHEN state = 'signup' AND t > z THEN 'post' END AS seg, CASE WHEN state IN ('view','purchase') THEN scan_id END AS scan FROM samples, b)")
def scan_split(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d)
    raw = s.select("survey_id", "t", F.col("scan_id").alias("sweep"), F.col("state").isin("view", "purchase").cast("int").alias("valid"), F.when(F.col("state") == "signup", 1).otherwise(-1).alias("cal_state"), (F.col("scan_id") * 1000 + F.col("sample_id")).alias("event_id"))
    return segment.split_raster(raw).select("event_id", "segment", "scan_id")


# joins by place


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Distinct places of lineitem, summed."""
    p = scatter_points(spark, d)
    return p.groupBy("x", "y").agg(F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum("w").alias("w"), F.count("*").alias("n"))


@query("bin_range_join", P + ", q AS (SELECT DISTINCT x, y FROM points) SELECT a.x, a.y, count(*) AS n_near, round(sum(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))), 4) + 0.0 AS total FROM q a JOIN q b ON sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 2.5 GROUP BY ALL")
def bin_range_join(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).select("x", "y")
    near = spatial.range_join(p, p.select(F.col("x").alias("x2"), F.col("y").alias("y2")), 2.5, ("x", "y"), ("x2", "y2"))
    return near.groupBy("x", "y").agg(F.count("*").alias("n_near"), (F.round(F.sum("distance"), 4) + 0.0).alias("total"))


@query("box_range_join", P + ", q AS (SELECT DISTINCT x, y FROM points) SELECT a.x, a.y, count(*) AS n_near FROM q a JOIN q b ON abs(a.x-b.x) <= 3 AND abs(a.y-b.y) <= 3 GROUP BY ALL")
def box_range_join(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).select("x", "y")
    near = spatial.range_join(p, p.select(F.col("x").alias("x2"), F.col("y").alias("y2")), 3.0, ("x", "y"), ("x2", "y2"), "box", reach=2)
    return near.groupBy("x", "y").agg(F.count("*").alias("n_near"))


@query("pair_counts", P + ", q AS (SELECT DISTINCT x, y FROM points) SELECT a.x, a.y, count(*) - 1 AS n_near FROM q a JOIN q b ON sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 1.5 GROUP BY ALL")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return spatial.pair_counts(_places(spark, d).select("x", "y"), [], "x", "y", 1.5)


@query(
    "nearest_adjacent_scan",
    S + """, n AS (SELECT a.scan_id, a.sample_id, b.scan_id - a.scan_id AS side, arg_min(b.flux, (abs(a.dec - b.dec), b.sample_id)) AS f FROM samples a JOIN samples b ON b.scan_id IN (a.scan_id - 1, a.scan_id + 1) GROUP BY ALL)
    SELECT s.scan_id, s.sample_id, max(f) FILTER (side = -1) AS prev_flux, max(f) FILTER (side = 1) AS next_flux FROM samples s LEFT JOIN n USING (scan_id, sample_id) GROUP BY ALL""",
)
def nearest_adjacent_scan(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_in_neighbours(event_samples(spark, d), "dec", ["flux"]).select("scan_id", "sample_id", "prev_flux", "next_flux")


@query(
    "edge_filter",
    P + """, e AS (SELECT scan_id, min(x) + scan_id AS xl, max(x) - 3 * scan_id AS xh, min(y) + 2 * scan_id AS yl, max(y) - 20 - scan_id AS yh, min(x) + 24 + scan_id AS cx, max(y) - 12 AS cy, 7.0 + scan_id AS r FROM points GROUP BY scan_id)
    SELECT DISTINCT x, y FROM points p WHERE EXISTS (SELECT 1 FROM e WHERE CASE WHEN e.scan_id % 2 = 0 THEN p.x > xl AND p.x < xh AND p.y > yl AND p.y < yh ELSE sqrt(pow(p.x-cx,2)+pow(p.y-cy,2)) < r - 1.0 END)""",
)
def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    """Places of the table inside the boxes and circles that it gives its scans."""
    p, k = scatter_points(spark, d), F.col("scan_id")
    e = p.groupBy("scan_id").agg((F.min("x") + k).alias("x_low"), (F.max("x") - 3 * k).alias("x_high"), (F.min("y") + 2 * k).alias("y_low"), (F.max("y") - 20 - k).alias("y_high"), (F.min("x") + 24 + k).alias("cx"), (F.max("y") - 12).alias("cy"))
    edges = e.withColumns({"radius": k + 7.0, "map_type": F.when(k % 2 == 0, "raster").otherwise("daisy")}).withColumnRenamed("scan_id", "survey_id")
    grid = p.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    return surface.in_footprint(grid, edges, 2.0, 0.5).select(F.col("px").alias("x"), F.col("py").alias("y"))


@query("radius_range_join", P + ", q AS (SELECT DISTINCT x, y, 0.5 + y % 5 * 0.75 AS r FROM points) SELECT a.x, a.y, count(*) AS n_near, round(sum(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))), 4) + 0.0 AS total FROM q a JOIN q b ON sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= a.r GROUP BY ALL")
def radius_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Each place has a radius of its own, from half a unit to three and a half."""
    p = _places(spark, d).select("x", "y")
    near = spatial.radius_join(p.withColumn("r", 0.5 + F.col("y") % 5 * 0.75), p.select(F.col("x").alias("x2"), F.col("y").alias("y2")), "r", ("x", "y"), ("x2", "y2"))
    return near.groupBy("x", "y").agg(F.count("*").alias("n_near"), (F.round(F.sum("distance"), 4) + 0.0).alias("total"))


@query(
    "convex_hulls",
    P + """, c AS (SELECT scan_id, x, min(y) AS lo, max(y) AS hi FROM points GROUP BY ALL), q AS (SELECT scan_id, x, lo AS y FROM c UNION SELECT scan_id, x, hi FROM c),
    a AS (SELECT p.scan_id, p.x, p.y, atan2(o.y - p.y, o.x - p.x) AS t FROM q p JOIN q o ON p.scan_id = o.scan_id AND (p.x, p.y) <> (o.x, o.y)),
    g AS (SELECT scan_id, x, y, coalesce(lead(t) OVER (PARTITION BY scan_id, x, y ORDER BY t), min(t) OVER (PARTITION BY scan_id, x, y) + 2 * pi()) - t AS gap FROM a)
    SELECT scan_id, x, y FROM g GROUP BY ALL HAVING max(gap) > pi() + 1e-9""",
)
def convex_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the hull of each scan's places: those that see all others within less than half a turn."""
    hulls = geometry.convex_hulls(scatter_points(spark, d), ["scan_id"], "x", "y")
    return hulls.select("scan_id", F.explode("hull").alias("c")).select("scan_id", "c.x", "c.y")


# surfaces

BEAM = 3.0
NEAR = P + ", g AS (SELECT i*2.0 AS px, j*2.0 AS py, i AS x_pix, j AS y_pix FROM range(26) a(i), range(23) b(j)), near AS (SELECT x_pix, y_pix, x - px AS dx, y - py AS dy, z, w, scan_id, sqrt(pow(x-px,2)+pow(y-py,2)) AS distance FROM g JOIN points ON abs(x-px) <= 3 AND abs(y-py) <= 3 WHERE sqrt(pow(x-px,2)+pow(y-py,2)) <= 3)"


def _near(spark: SparkSession, d: str) -> DataFrame:
    grid = surface.pixel_grid(spark, (0.0, 50.0), (0.0, 44.0), 2.0)
    return surface.near_pixels(grid, scatter_points(spark, d), BEAM, "x", "y")


@query(
    "plane_surface",
    NEAR + """, m AS (SELECT x_pix, y_pix, count(*) AS n, sum(w) s, sum(w*dx) x, sum(w*dy) y, sum(w*dx*dx) xx, sum(w*dx*dy) xy, sum(w*dy*dy) yy, sum(w*z) p, sum(w*z*dx) q, sum(w*z*dy) r FROM near GROUP BY ALL)
    SELECT x_pix::INT AS x_pix, y_pix::INT AS y_pix, n, round(s, 5) AS weight, round(CASE WHEN s*(xx*yy-xy*xy) - x*(x*yy-xy*y) + y*(x*xy-xx*y) > 1e-9*s*xx*yy THEN (p*(xx*yy-xy*xy) - x*(q*yy-xy*r) + y*(q*xy-xx*r)) / (s*(xx*yy-xy*xy) - x*(x*yy-xy*y) + y*(x*xy-xx*y)) END, 6) + 0.0 AS flux FROM m""",
)
def plane_surface(spark: SparkSession, d: str) -> DataFrame:
    return surface.plane(_near(spark, d), ["x_pix", "y_pix"], "z", F.col("w")).select("x_pix", "y_pix", "n", F.round("weight", 5).alias("weight"), r6("flux").alias("flux"))


@query(
    "sampling_class",
    NEAR + ", c AS (SELECT x_pix, y_pix, scan_id, count(*) AS n FROM near GROUP BY ALL) SELECT x_pix::INT AS x_pix, y_pix::INT AS y_pix, CASE WHEN count(*) >= 5 AND max(n) >= 5 AND sum(n) >= 10 THEN 10 WHEN count(*) >= 4 AND max(n) >= 4 AND sum(n) >= 6 THEN 6 WHEN count(*) >= 2 AND max(n) >= 2 AND sum(n) >= 3 THEN 3 ELSE 0 END AS terms FROM c GROUP BY 1, 2",
)
def sampling_class(spark: SparkSession, d: str) -> DataFrame:
    return surface.sampling_class(_near(spark, d), ["x_pix", "y_pix"]).select("x_pix", "y_pix", "terms")


KERNEL = "pow(cos(pi()/2*distance/3.0), ln(0.5)/ln(cos(pi()/4/3)))"


@query(
    "kernel_weight_map",
    NEAR + f" SELECT x_pix::INT AS x_pix, y_pix::INT AS y_pix, round(sum(CASE WHEN distance < 3 THEN {KERNEL} ELSE 0 END), 5) AS weight, round(sum(CASE WHEN distance < 3 THEN {KERNEL} ELSE 0 END * z) / nullif(sum(CASE WHEN distance < 3 THEN {KERNEL} ELSE 0 END), 0), 6) + 0.0 AS flux FROM near GROUP BY ALL",
)
def kernel_weight_map(spark: SparkSession, d: str) -> DataFrame:
    k = surface.kernel(F.col("distance"), BEAM, 1 / 3)
    return _near(spark, d).withColumn("k", k).groupBy("x_pix", "y_pix").agg(F.round(F.sum("k"), 5).alias("weight"), r6(F.sum(F.col("k") * F.col("z")) / F.nullif(F.sum("k"), F.lit(0.0))).alias("flux"))


@query(
    "rfi_local_fit",
    NEAR + """, a AS (SELECT x_pix, y_pix, sum(w) s, sum(w*z*p) f, sum(w*z) z, sum(w*p) p, sum(w*p*p) q FROM (SELECT *, pow(cos(pi()*distance/6.0), 2) AS p FROM near) GROUP BY ALL)
    SELECT x_pix::INT AS x_pix, y_pix::INT AS y_pix, CASE WHEN q > 1e-9*s AND 2*s*q - p*p > 2e-9*s*q THEN round((2*s*f - z*p)/(2*s*q - p*p), 6) + 0.0 END AS f, CASE WHEN q > 1e-9*s AND 2*s*q - p*p > 2e-9*s*q THEN round((z - (2*s*f - z*p)/(2*s*q - p*p)*p)/(2*s), 6) + 0.0 END AS g FROM a""",
)
def rfi_local_fit(spark: SparkSession, d: str) -> DataFrame:
    fits = neighbourhood.local_fits(_near(spark, d), ["x_pix", "y_pix"], "z", "w", BEAM)
    return fits.select("x_pix", "y_pix", r6("f").alias("f"), r6("g").alias("g"))


@query("path_layer", P + ", l AS (SELECT round(x/2.0)::INT AS x_pix, round(y/2.0)::INT AS y_pix, max(scan_id) AS s FROM points GROUP BY ALL) SELECT x_pix, y_pix, CASE WHEN s % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS path FROM l")
def path_layer(spark: SparkSession, d: str) -> DataFrame:
    p = scatter_points(spark, d).withColumn("sample_id", F.lit(0))
    return surface.path_layer(p, "x", "y", 0.0, 0.0, 2.0).select("x_pix", "y_pix", "path")


@query("brightest_pixel", P + " SELECT x, y, round(sum(w*z), 6) AS flux FROM points GROUP BY x, y ORDER BY round(sum(w*z), 6) DESC, y, x LIMIT 1")
def brightest_pixel(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).select("x", "y", F.round("wz", 6).alias("flux"))
    return surface.brightest(p, order=["y", "x"])


@query("aperture_sum", P + ", q AS (SELECT x, y, sum(w*z) AS flux, sum(w) AS weight FROM points GROUP BY x, y), s(source_id, sx, sy) AS (VALUES (1, 25.0, 10.0), (2, 10.0, 20.0)) SELECT source_id, count(*) AS n_pixels, round(sum(flux), 5) AS flux_sum, round(max(flux), 6) AS peak FROM s JOIN q ON sqrt(pow(x-sx,2)+pow(y-sy,2)) <= 4 GROUP BY 1")
def aperture_sum(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("wz").alias("flux"), F.col("w").alias("weight"))
    sources = spark.createDataFrame([(1, 25.0, 10.0), (2, 10.0, 20.0)], "source_id int, sx double, sy double")
    return photometry.aperture(p, sources, 4.0).select("source_id", "n_pixels", F.round("flux_sum", 5).alias("flux_sum"), r6("peak").alias("peak"))


# iterative operators: no SQL form; tests compare them with brute force and planted truth


@query("rcr_flags")
def rcr_flags(spark: SparkSession, d: str) -> DataFrame:
    return rcr.flagged(event_samples(spark, d).select("scan_id", "sample_id", "flux", "dumps"), ["scan_id"], "flux", "dumps", "LS_MODE_DL", order=["sample_id"])


@query("rcr_single")
def rcr_single(spark: SparkSession, d: str) -> DataFrame:
    return rcr.by_group(event_samples(spark, d), ["scan_id"], "flux", "dumps", "SS_MEDIAN_DL")


@query("rcr_line")
def rcr_line(spark: SparkSession, d: str) -> DataFrame:
    return rcr.line_by_group(event_samples(spark, d).withColumn("x", F.col("sample_id").cast("double")), ["scan_id"], "x", "flux", "dumps")


@query("scan_scatter")
def scan_scatter(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.scan_scatter(event_samples(spark, d), x="t")


@query("plane_scatter")
def plane_scatter(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d)
    return calibrate.plane_scatter(s, calibrate.scan_scatter(s, x="t"), along="dec")


@query("background_model")
def background_model(spark: SparkSession, d: str) -> DataFrame:
    s = ordered.path_length(event_samples(spark, d)).withColumn("scatter", F.lit(20.0))
    return background.background(s, 12.0).select("scan_id", "sample_id", "background")


@query("time_shift")
def time_shift(spark: SparkSession, d: str) -> DataFrame:
    return timeshift.adjacent_lags(event_samples(spark, d), "ra", "flux")


@query("rfi_clean")
def rfi_clean(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d).withColumn("scatter2d", F.lit(20.0))
    return neighbourhood.interference_models(s, 0.15)


@query("polynomial_surface")
def polynomial_surface(spark: SparkSession, d: str) -> DataFrame:
    return surface.surfaces(_near(spark, d), ["x_pix", "y_pix"], "z", F.col("w"), noise_prior=True)


@query("edge_lines")
def edge_lines(spark: SparkSession, d: str) -> DataFrame:
    return geometry.edge_lines(event_samples(spark, d))


@query(
    "half_sample_mode",
    f"""WITH RECURSIVE {EVENT_SAMPLES}, p AS (SELECT scan_id, flux AS y, dumps AS w, row_number() OVER (PARTITION BY scan_id ORDER BY flux, dumps) AS i FROM samples),
    st AS (
      SELECT scan_id, 1::BIGINT AS lo, count(*)::BIGINT AS hi, 0 AS step FROM p GROUP BY scan_id
      UNION ALL
      (WITH q AS (SELECT st.scan_id, st.lo, st.hi, st.step, p.i, p.y, sum(p.w) OVER (PARTITION BY p.scan_id ORDER BY p.i) - p.w / 2 AS pos, sum(p.w) OVER (PARTITION BY p.scan_id) / 2 AS half
                  FROM st JOIN p ON p.scan_id = st.scan_id AND p.i BETWEEN st.lo AND st.hi WHERE st.hi - st.lo >= 2),
       s AS (SELECT a.scan_id, a.lo, a.hi, a.step, a.i AS first, max(b.i) AS last FROM q a JOIN q b USING (scan_id) WHERE a.pos <= a.half * (1 + 1e-8) AND b.pos <= (a.pos + a.half) * (1 + 1e-8) GROUP BY ALL
             UNION ALL SELECT a.scan_id, a.lo, a.hi, a.step, min(b.i), a.i FROM q a JOIN q b USING (scan_id) WHERE a.pos >= a.half * (1 - 1e-8) AND b.pos >= (a.pos - a.half) * (1 - 1e-8) GROUP BY a.scan_id, a.lo, a.hi, a.step, a.i),
       t AS (SELECT s.*, z.y - x.y AS span, min(z.y - x.y) OVER (PARTITION BY s.scan_id) AS best FROM s JOIN p x ON x.scan_id = s.scan_id AND x.i = s.first JOIN p z ON z.scan_id = s.scan_id AND z.i = s.last)
       SELECT scan_id, min(first), max(last), any_value(step) + 1 FROM t WHERE span <= best + 1e-8 * greatest(abs(best), 1e-300) GROUP BY scan_id HAVING min(first) > any_value(lo) OR max(last) < any_value(hi))),
    e AS (SELECT scan_id, lo, hi FROM st QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY step DESC) = 1),
    c AS (SELECT p.scan_id, p.i, p.y, sum(p.w) OVER (PARTITION BY p.scan_id ORDER BY p.i) - p.w / 2 AS pos, sum(p.w) OVER (PARTITION BY p.scan_id) / 2 AS half FROM p JOIN e ON p.scan_id = e.scan_id AND p.i BETWEEN e.lo AND e.hi),
    d AS (SELECT scan_id, arg_max(y, i) FILTER (pos <= half) AS y0, max(pos) FILTER (pos <= half) AS a0, arg_min(y, i) FILTER (pos > half) AS y1, min(pos) FILTER (pos > half) AS a1, any_value(half) AS half, min(y) AS low FROM c GROUP BY scan_id)
    SELECT scan_id, round(CASE WHEN y0 IS NULL THEN low WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (half - a0) / (a1 - a0) END, 6) + 0.0 AS mode FROM d""",
)
def half_sample_mode(spark: SparkSession, d: str) -> DataFrame:
    """The half-sample mode of each scan's weighted fluxes."""

    def run(y: np.ndarray, w: np.ndarray) -> tuple:
        return (rcr.mode(y, w),)

    found = summarised(event_samples(spark, d), ["scan_id"], ["flux", "dumps"], "mode double", run, ["flux", "dumps"])
    return found.select("scan_id", r6("mode").alias("mode"))


from starloom.plans import more_queries, robust_queries  # noqa: E402, F401  (register their queries)
