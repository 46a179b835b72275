"""Queries of scalar, filter, geometry and layer operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scalar
from starloom.operators import calibrate, geometry, neighbourhood, ordered, segment, spectral, surface
from starloom.plans.catalogue import query
from starloom.sources.adapter import EVENT_SAMPLES, SCATTER_POINTS, event_samples, scatter_points, spectra, table

S = f"WITH {EVENT_SAMPLES} "
P = f"WITH {SCATTER_POINTS} "


def r6(c):
    """Rounded for comparison; -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


@query("centred_distance", S + """, c AS (SELECT scan_id, sample_id, radians((dec - 20) + 20) AS d, radians((ra - 100) * cos(radians(20.0)) / cos(radians(20.0))) AS a FROM samples)
SELECT scan_id, sample_id, round(degrees(acos(greatest(-1.0, least(1.0, sin(d) * sin(radians(20.0)) + cos(d) * cos(radians(20.0)) * cos(a))))), 6) AS distance FROM c""")  # fmt: skip
def centred_distance(spark: SparkSession, d: str) -> DataFrame:
    s = geometry.centred(event_samples(spark, d), 100.0, 20.0)
    far = scalar.centred_distance(F.col("working_dec"), F.col("working_ra"), F.lit(0.0), F.lit(0.0), 20.0)
    return s.select("scan_id", "sample_id", r6(F.degrees(far)).alias("distance"))


@query("nearly_equal", "SELECT l_orderkey, l_linenumber, count(*) AS n, sum((abs(l_extendedprice - l_extendedprice * (1 + l_tax * 1e-7)) <= 1e-8 * greatest(abs(l_extendedprice), abs(l_extendedprice * (1 + l_tax * 1e-7))))::INT) AS equal FROM lineitem GROUP BY 1, 2")
def nearly_equal(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax") * 1e-7)
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(scalar.nearly_equal(a, b).cast("int")).alias("equal"))


@query("header_values", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'equatorial' WHEN p_partkey % 3 = 1 THEN 'galactic' END AS coordinates, 0.0::DOUBLE AS brand,
coalesce(TRY_CAST(substr(p_brand, 7) AS DOUBLE), 0.0) AS number, CASE WHEN p_partkey % 4 = 0 THEN 'daisy' WHEN p_partkey % 4 < 3 THEN 'raster' END AS map_type, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 = 1 END AS scans_in_ra,
CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN p_size::DOUBLE END AS value FROM part""")  # fmt: skip
def header_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    coordinates = F.when(k % 3 == 0, "RA_DEC").when(k % 3 == 1, "LNG_LAT").otherwise("AZ_EL")
    mode = F.when(k % 4 == 0, "DAISY").when(k % 4 == 1, "ralongmap").when(k % 4 == 2, "declatmap").otherwise("track")
    value = F.when(F.col("p_size") % 5 == 0, float("nan")).when(F.col("p_size") % 7 == 0, -999999.0).otherwise(F.col("p_size").cast("double"))
    p = table(spark, d, "part").withColumn("pattern", scalar.map_pattern(mode))
    return p.select("p_partkey", scalar.coordinate_system(coordinates).alias("coordinates"), scalar.number(F.col("p_brand")).alias("brand"), scalar.number(F.substring("p_brand", 7, 10)).alias("number"), "pattern.map_type", "pattern.scans_in_ra", scalar.unset(value).alias("value"))


@query("beam_widths", "SELECT telescope, round(1.22 * 299792458.0 * 180 / ((1 + n_nationkey / 10.0) * 1e9 * d * pi()), 9) AS beam, n_nationkey FROM nation, (VALUES ('20m', 20.0), ('gbt', 105.0), ('40ft', 12.192)) v(telescope, d)")
def beam_widths(spark: SparkSession, d: str) -> DataFrame:
    by = F.explode(F.array(*[F.struct(F.lit(k).alias("telescope"), F.lit(scalar.beam_width(1.0, k)).alias("one")) for k in scalar.DISHES]))
    return table(spark, d, "nation").select("n_nationkey", by.alias("b")).select("b.telescope", F.round(F.col("b.one") / (1 + F.col("n_nationkey") / 10), 9).alias("beam"), "n_nationkey")


@query("frequency_axis", "SELECT vec_id AS row_id, (1.4e6 - 32 * 0.25 + 0.25)::DOUBLE AS low, (1.4e6 - 32 * 0.25 + 0.25 + 63 * 0.25)::DOUBLE AS high, 64 AS n FROM embeddings")
def frequency_axis(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).withColumn("axis", spectral.frequency_axis(F.size("data"), 0.25, 1.4, 32.0))
    return s.select("row_id", r6(F.array_min("axis")).alias("low"), r6(F.array_max("axis")).alias("high"), F.size("axis").alias("n"))


@query("masked_channels", "SELECT vec_id AS row_id, len(list_filter(embedding, lambda x: x >= 0)) AS n, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN x::DOUBLE ELSE 0.0 END)), 6) AS total FROM embeddings")
def masked_channels(spark: SparkSession, d: str) -> DataFrame:
    s = spectra(spark, d).withColumn("data", spectral.mask_nan(F.transform("data", lambda x: F.when(x < 0, float("nan")).otherwise(x))))
    return s.select("row_id", F.size(F.filter("data", lambda x: x.isNotNull())).alias("n"), r6(F.aggregate("data", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("total"))


@query("baseline_zones", """WITH v AS (SELECT j, (1420.4 - (1420.4 + (j - 32) * 0.05)) / 1420.4 * 299792.458 AS v FROM range(64) r(j)), z AS (SELECT j, CASE WHEN v BETWEEN 100 AND 400 THEN 3.0 WHEN v BETWEEN -200 AND 200 THEN 2.0 ELSE 6.0 END AS scale FROM v)
SELECT vec_id AS row_id, j::INT AS channel, scale::DOUBLE AS scale FROM embeddings, z""")  # fmt: skip
def baseline_zones(spark: SparkSession, d: str) -> DataFrame:
    axis = F.transform(F.sequence(F.lit(0), F.size("data") - 1), lambda j: F.lit(1420.4) + (j - 32) * 0.05)
    zones = spectral.baseline_zones(axis, 1420.4, [(-200.0, 200.0, 2.0), (100.0, 400.0, 3.0)], 6.0)
    return spectra(spark, d).select("row_id", F.posexplode(zones).alias("channel", "scale"))


@query("cross_repair", S + """, c AS (SELECT *, lead((sample_id * 50) % 360) OVER w - (sample_id * 50) % 360 < -180 AS crossed FROM samples WINDOW w AS (PARTITION BY survey_id, scan_id ORDER BY sample_id))
SELECT scan_id, sample_id, ((sample_id * 50) % 360 - 360 * coalesce(max(crossed::INT) OVER (PARTITION BY survey_id, scan_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0))::DOUBLE AS angle FROM c""")  # fmt: skip
def cross_repair(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d).withColumn("a", F.pmod(F.col("sample_id") * 50, F.lit(360)).cast("double"))
    return ordered.cross_repair(s, ["survey_id", "scan_id"], "sample_id", "a", 360.0, "angle").select("scan_id", "sample_id", "angle")


@query("petals", S + """, c AS (SELECT *, row_number() OVER (PARTITION BY survey_id, scan_id ORDER BY sqrt(pow(ra - 102.4, 2) + pow(dec - 21.5, 2)), sample_id) AS k FROM samples),
m AS (SELECT survey_id, scan_id, sample_id AS center_idx FROM c WHERE k = 1)
SELECT scan_id, sample_id, center_idx, round((CASE WHEN sample_id < center_idx THEN -1 ELSE 1 END) * (CASE WHEN scan_id % 2 = 0 THEN 1 ELSE -1 END) * abs(dec - 21.5), 6) + 0.0 AS radius,
round((ra - 100) * cos(radians(dec)), 6) + 0.0 AS working_ra, round((ra - 100) * cos(radians(dec)) / cos(radians(dec)) + 100, 6) AS back FROM samples JOIN m USING (survey_id, scan_id)""")  # fmt: skip
def petals(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d)
    j = s.join(geometry.petal_centres(s, 102.4, 21.5), ["survey_id", "scan_id"]).withColumn("far", F.abs(F.col("dec") - 21.5))
    j = geometry.dynamic_scale(ordered.daisy_radius(j, "far"), 100.0)
    back = geometry.undo_dynamic_scale(j, 100.0).select("scan_id", "sample_id", r6("ra").alias("back"))
    return j.select("scan_id", "sample_id", "center_idx", r6("radius").alias("radius"), r6("working_ra").alias("working_ra")).join(back, ["scan_id", "sample_id"])


@query("calibration_segments", S + """, r AS (SELECT scan_id, sample_id, t, (dumps > 2)::INT AS cal, (state IN ('view', 'purchase'))::INT AS valid FROM samples),
c AS (SELECT *, min(t) FILTER (valid = 1) OVER (PARTITION BY scan_id) AS f, max(t) FILTER (valid = 1) OVER (PARTITION BY scan_id) AS l, coalesce((lag(cal) OVER (PARTITION BY scan_id ORDER BY t) <> cal)::INT, 1) AS new FROM r)
SELECT scan_id, sample_id, CASE WHEN valid = 1 THEN 'scan' WHEN t < f THEN 'pre' WHEN t > l THEN 'post' END AS segment, sum(new) OVER (PARTITION BY scan_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c""")  # fmt: skip
def calibration_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = event_samples(spark, d).select("scan_id", "sample_id", "t", (F.col("dumps") > 2).cast("int").alias("cal_state"), F.col("state").isin("view", "purchase").cast("int").alias("sweep_valid"))
    return calibrate.calibration_segments(rows, ["scan_id"]).select("scan_id", "sample_id", "segment", "run")


@query("footprint", S + """, m AS (SELECT (scan_id % 3)::INT AS survey_id, ra, dec FROM samples), c AS (SELECT survey_id, min(ra) AS x_low, max(ra) AS x_high, min(dec) AS y_low, max(dec) AS y_high, median(ra) AS cx, median(dec) AS cy FROM m GROUP BY 1)
SELECT survey_id, round(x_low, 6) AS x_low, round(x_high, 6) AS x_high, round(y_low, 6) AS y_low, round(y_high, 6) AS y_high, round(cx, 6) AS cx, round(cy, 6) AS cy, round(max(sqrt(pow(ra - cx, 2) + pow(dec - cy, 2))), 6) AS radius
FROM c JOIN m USING (survey_id) GROUP BY survey_id, x_low, x_high, y_low, y_high, cx, cy""")  # fmt: skip
def footprint(spark: SparkSession, d: str) -> DataFrame:
    f = geometry.footprint(event_samples(spark, d).withColumn("survey_id", (F.col("scan_id") % 3).cast("int")))
    return f.select("survey_id", *[r6(c).alias(c) for c in ("x_low", "x_high", "y_low", "y_high", "cx", "cy", "radius")])


BOXES = "boxes(b_id, xl, xh, yl, yh, gap) AS (VALUES (0, 99.0, 110.0, 19.0, 30.0, 0.5), (1, 101.02, 103.02, 20.521, 22.021, 0.2), (2, 102.02, 104.52, 21.021, 21.521, 0.1))"


@query("least_gap", S + f", {BOXES} SELECT scan_id, sample_id, min(gap)::DOUBLE AS min_gap FROM samples JOIN boxes ON ra BETWEEN xl AND xh AND dec BETWEEN yl AND yh OR survey_id = b_id GROUP BY 1, 2")
def least_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = [(0, 99.0, 110.0, 19.0, 30.0, 0.5), (1, 101.02, 103.02, 20.521, 22.021, 0.2), (2, 102.02, 104.52, 21.021, 21.521, 0.1)]
    boxes = spark.createDataFrame(rows, "survey_id int, x_low double, x_high double, y_low double, y_high double, gap double")
    return geometry.least_gap(event_samples(spark, d), boxes.drop("gap"), boxes.select("survey_id", "gap")).select("scan_id", "sample_id", "min_gap")


@query("scan_filters", S + """, n AS (SELECT *, count(*) OVER (PARTITION BY survey_id, scan_id) AS n, first_value(ra) OVER w AS ra_a, first_value(dec) OVER w AS dec_a, last_value(ra) OVER w AS ra_b, last_value(dec) OVER w AS dec_b FROM samples
WINDOW w AS (PARTITION BY survey_id, scan_id ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT scan_id, sample_id, round((flux + dumps) / 2 * 3, 6) AS flux FROM n WHERE n > 1 AND least(sqrt(pow(ra - ra_a, 2) + pow(dec - dec_a, 2)), sqrt(pow(ra - ra_b, 2) + pow(dec - dec_b, 2))) >= 0.52""")  # fmt: skip
def scan_filters(spark: SparkSession, d: str) -> DataFrame:
    s = event_samples(spark, d).withColumns({"segment": F.lit("scan"), "flux_l": F.col("flux"), "flux_r": F.col("dumps")})
    s = segment.jansky_scale(segment.working_channel(segment.composite_flux(segment.usable_scans(s)), "composite"), 3.0)
    return segment.trim_turning_edges(s, 1.3, 0.4, geometry.turning_points(s)).select("scan_id", "sample_id", r6("flux").alias("flux"))


@query("background_and_models", S + "SELECT scan_id, sample_id, round(flux - dumps, 6) AS model, round(dumps, 6) AS lss_data, 0.25::DOUBLE AS theta_gap FROM samples WHERE dumps < 4")
def background_and_models(spark: SparkSession, d: str) -> DataFrame:
    s = segment.subtract_background(event_samples(spark, d).withColumn("background", F.col("dumps")))
    models = s.filter("dumps < 5").select("survey_id", "scan_id", "sample_id", F.when(F.col("dumps") == 4, float("nan")).otherwise(F.col("flux")).alias("model"))
    return neighbourhood.forced_gap(segment.apply_models(s, models), 0.25).select("scan_id", "sample_id", r6("flux").alias("model"), r6("lss_data").alias("lss_data"), "theta_gap")


@query("parsable_times", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def parsable_times(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("when", F.when(F.col("o_orderkey") % 3 == 0, "no time").otherwise("2020-01-02T03:04:05"))
    return segment.parsable_times(o, "when").select("o_orderkey")


@query("map_layers", P + """, near AS (SELECT a.x AS px, a.y AS py, b.w, b.scan_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, 0.5 + b.scan_id * 0.1 AS g, 1.0 + b.scan_id AS c
FROM (SELECT DISTINCT x, y FROM points WHERE x % 5 = 0 AND y % 4 = 0) a JOIN points b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 3),
v AS (SELECT *, pow(-ln(greatest(distance, 3e-6) / 3), -2.329267 * ln(g / 2 / 3) - 0.510417) AS gw FROM near)
SELECT px, py, round(sum(w), 6) AS weight, round(sum(gw * g) / sum(gw), 6) AS gap, round(sum(w * sqrt(pow(c / 3, 2) + 9.0 / 9)) / sum(w), 6) AS correlation,
round(greatest(1 / 3.0::DOUBLE, least(sum(gw * g) / sum(gw) * (4.0 / 3) / 3, 1.0)), 6) AS scale FROM v GROUP BY 1, 2""")  # fmt: skip
def map_layers(spark: SparkSession, d: str) -> DataFrame:
    p = scatter_points(spark, d)
    pixels = p.filter("x % 5 = 0 and y % 4 = 0").select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    near = surface.near_pixels(pixels, p, 3.0, "x", "y").filter("distance < 3").withColumns({"g": F.lit(0.5) + F.col("scan_id") * 0.1, "c": F.lit(1.0) + F.col("scan_id")})
    out = surface.layers(near, ["px", "py"], F.col("w"), "g", "c", 3.0, 1 / 3)
    return out.select("px", "py", *[r6(c).alias(c) for c in ("weight", "gap", "correlation", "scale")])


THETA = S + """, p AS (SELECT scan_id, sample_id, ra, dec, floor(ra / 0.3)::INT AS cx, floor(dec / 0.3)::INT AS cy FROM samples), o AS (SELECT * FROM p),
e AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM o), f AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM e),
n AS (SELECT p.scan_id, p.sample_id, f.ra - p.ra AS dx, f.dec - p.dec AS dy FROM p JOIN f ON p.cx = f.cx + f.ox AND p.cy = f.cy + f.oy WHERE sqrt(pow(f.ra - p.ra, 2) + pow(f.dec - p.dec, 2)) < 0.3 AND (f.ra <> p.ra OR f.dec <> p.dec)),
k AS (SELECT k, cos(k * pi() / 4) AS c, sin(k * pi() / 4) AS s FROM range(8) r(k)),
u AS (SELECT scan_id, sample_id, k, (dx * dx + dy * dy) / (c * dx + s * dy) AS touch FROM n, k WHERE c * dx + s * dy >= abs(c * dy - s * dx) - 1e-12 AND c * dx + s * dy > 1e-12),
g AS (SELECT scan_id, sample_id, k, min(touch) AS touch FROM u GROUP BY 1, 2, 3)
SELECT p.scan_id, p.sample_id, round(radians(least(0.75 * 0.3, max(least(0.3, coalesce(g.touch, 0.3))))), 6) AS theta_gap FROM p CROSS JOIN k LEFT JOIN g ON g.scan_id = p.scan_id AND g.sample_id = p.sample_id AND g.k = k.k GROUP BY 1, 2"""


@query("theta_gap", THETA)
def theta_gap(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.sampling_gap(event_samples(spark, d), 0.3).select("scan_id", "sample_id", r6("theta_gap").alias("theta_gap"))
