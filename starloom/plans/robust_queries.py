"""Queries of the parts of robust rejection, of source detection and of a daisy's extent over the driver's tables, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import levelling, photometry, rcr, rcr_values
from starloom.operators.grouped import summarised
from starloom.plans.catalogue import query
from starloom.sources.adapter import EVENT_SAMPLES, SCATTER_POINTS, event_samples, scatter_points

S = f"WITH {EVENT_SAMPLES} "
P = f"WITH {SCATTER_POINTS} "


def r6(c):
    """Rounded for comparison; -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


@query(
    "normal_axis",
    S + """, r AS (SELECT scan_id, (sum(dumps) OVER (PARTITION BY scan_id ORDER BY sample_id) - 0.317311 * dumps) / sum(dumps) OVER (PARTITION BY scan_id) AS p FROM samples),
    l AS (SELECT scan_id, ln(1 - p * p) AS g, 2 / (pi() * 0.147) + ln(1 - p * p) / 2 AS t FROM r)
    SELECT scan_id, count(*) AS n, round(sum(sqrt(2.0) * sqrt(sqrt(t * t - g / 0.147) - t)), 5) AS total, round(max(sqrt(2.0) * sqrt(sqrt(t * t - g / 0.147) - t)), 6) AS last FROM l GROUP BY scan_id""",
)
def normal_axis(spark: SparkSession, d: str) -> DataFrame:
    """Normal deviations that ranks of weighted samples stand for."""

    def run(w: np.ndarray, _: np.ndarray) -> tuple:
        x = rcr.normal_axis(w)
        return len(x), float(x.sum()), float(x.max())

    found = summarised(event_samples(spark, d), ["scan_id"], ["dumps", "sample_id"], "n bigint, total double, last double", run, ["sample_id"])
    return found.select("scan_id", "n", F.round("total", 5).alias("total"), r6("last").alias("last"))


#: Corrections of more than 100 values of unequal weights, and thresholds of more than 1000, as functions of n, log10 n = k and the weights' variation x.
_CORRECTED = {
    "SS_MEDIAN_DL": "pow(10, pow(10, 0.0243 - 0.7914 * k + (4.5073 + 0.1196 * k) * log10(x))) / (1 - 3.578 * pow(n, -0.942))",
    "LS_MODE_68": "pow(10, pow(10, -0.6482 - 0.5408 * k + (1.4154 + CASE WHEN n % 2 = 0 THEN 0.363528 ELSE -0.363528 END) * log10(x))) / (1 - 2.3525 * pow(n, -0.627))",
    "LS_MODE_DL": "pow(10, pow(10, -0.4412 - 0.4282 * k + (2.988077 + CASE WHEN n % 2 = 0 THEN 0.753032 ELSE -0.753032 END) * log10(x))) / (1 - 3.3245 * pow(n, -0.65))",
    "ES_MODE_DL": "pow(10, pow(10, -0.6097 - 0.5989 * k + (-0.3893 + 1.4123 * k) * log10(x))) / (1 - 3.1666 * pow(n, -0.833))",
}
_PREFERRED = {
    "single": "39.2519 * pow(n, -0.7969) + 1.8688",
    "lower": "pow(1.3399, pow(n, 0.1765)) / pow(10, pow(10, -2.5852 + 0.3861 * k + (1.4479 + 0.0424 * k) * log10(x)))",
    "each": "pow(1.2591, pow(n, 0.2052)) / pow(10, pow(10, -1.1827 + 1.8064 * log10(x)))",
}
_GROUPS = P + ", g AS (SELECT scan_id, count(*) AS n, log10(count(*)) AS k, stddev_samp(w) / avg(w) AS x FROM points GROUP BY scan_id HAVING count(*) > {least}) "


@query("spread_corrections", _GROUPS.format(least=100) + " UNION ALL ".join(f"SELECT scan_id, '{t}' AS technique, round({f}, 6) AS factor FROM g" for t, f in _CORRECTED.items()))
def spread_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Factor of each technique's spread for the weights of every scan of more than 100 points."""

    def run(w: np.ndarray) -> tuple:
        return (len(w), *(rcr_values.correction(t, w) for t in rcr.TECHNIQUES))

    found = summarised(scatter_points(spark, d), ["scan_id"], ["w"], "n bigint, " + ", ".join(f"{t} double" for t in rcr.TECHNIQUES), run).filter("n > 100")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("technique"), r6(t).alias("factor")) for t in rcr.TECHNIQUES)))
    return found.select("scan_id", each.alias("c")).select("scan_id", "c.technique", "c.factor")


@query("line_thresholds", _GROUPS.format(least=1000) + " UNION ALL ".join(f"SELECT scan_id, '{t}' AS sides, round({f}, 6) AS threshold FROM g" for t, f in _PREFERRED.items()))
def line_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Gain from which a broken line is preferred, for the weights of every scan of more than 1000 points."""
    sides = tuple(_PREFERRED)

    def run(w: np.ndarray) -> tuple:
        return (len(w), *(rcr_values.threshold(t, len(w), w) for t in sides))

    found = summarised(scatter_points(spark, d), ["scan_id"], ["w"], "n bigint, " + ", ".join(f"{t} double" for t in sides), run).filter("n > 1000")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("sides"), r6(t).alias("threshold")) for t in sides)))
    return found.select("scan_id", each.alias("c")).select("scan_id", "c.sides", "c.threshold")


_PLACES = P + ", q AS (SELECT x, y, round(sum(w * z), 6) AS flux FROM points GROUP BY x, y)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return scatter_points(spark, d).groupBy("x", "y").agg(r6(F.sum(F.col("w") * F.col("z"))).alias("flux"))


@query(
    "detected_sources",
    f"""WITH RECURSIVE {_PLACES[5:]}, b AS (SELECT x, y, flux FROM q WHERE flux >= 3 * (SELECT round(avg(flux), 6) FROM q)),
    c AS (SELECT a.x, a.y, a.flux FROM b a JOIN b o ON sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) <= 3.5 GROUP BY ALL HAVING count(*) >= 2),
    g AS (SELECT []::STRUCT(x DOUBLE, y DOUBLE)[] AS chosen, 0 AS k
          UNION ALL SELECT list_append(chosen, n), k + 1 FROM (SELECT g.chosen, g.k, arg_min({{'x': c.x, 'y': c.y}}, (-c.flux, c.y, c.x)) AS n FROM g, c
          WHERE len(list_filter(g.chosen, lambda o: sqrt(pow(o.x - c.x, 2) + pow(o.y - c.y, 2)) <= 3.5)) = 0 GROUP BY g.chosen, g.k) WHERE n IS NOT NULL)
    SELECT s.x AS x, s.y AS y, (i - 1)::INT AS source_id FROM (SELECT unnest(chosen) AS s, generate_subscripts(chosen, 1) AS i FROM g WHERE k = (SELECT max(k) FROM g))""",
)
def detected_sources(spark: SparkSession, d: str) -> DataFrame:
    """Places three times as bright as the mean that have another such place within 3.5 units, brightest first, 3.5 units apart."""
    q = _places(spark, d)
    mean = q.agg(r6(F.avg("flux")).alias("scatter"))
    samples = q.join(F.broadcast(mean)).select(F.lit(0).alias("survey_id"), F.col("y").cast("int").alias("scan_id"), F.col("x").cast("int").alias("sample_id"), F.col("x").alias("ra"), F.col("y").alias("dec"), "flux", "scatter")
    return photometry.detect(samples, 3.5, 3.0, 2, "scatter").select(F.col("ra").alias("x"), F.col("dec").alias("y"), "source_id")


@query(
    "brightest_sources",
    _PLACES + """, a AS (SELECT * FROM q ORDER BY flux DESC, y, x LIMIT 1), b AS (SELECT q.* FROM q, a WHERE pow(q.x - a.x, 2) + pow(q.y - a.y, 2) > 36 ORDER BY q.flux DESC, q.y, q.x LIMIT 1),
    c AS (SELECT q.* FROM q, a, b WHERE pow(q.x - a.x, 2) + pow(q.y - a.y, 2) > 36 AND pow(q.x - b.x, 2) + pow(q.y - b.y, 2) > 36 ORDER BY q.flux DESC, q.y, q.x LIMIT 1)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def brightest_sources(spark: SparkSession, d: str) -> DataFrame:
    """The three brightest places, each more than six units from those before."""
    pixels = _places(spark, d).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("x").cast("int").alias("x_pix"), F.col("y").cast("int").alias("y_pix"), "flux")
    return spark.createDataFrame(photometry.top_sources(pixels, 3, 6.0), "x double, y double, flux double")


@query(
    "daisy_extent",
    S + """, e AS (SELECT scan_id AS survey_id, (min(ra) + max(ra)) / 2 AS x, (min(dec) + max(dec)) / 2 AS y FROM samples GROUP BY scan_id)
    SELECT e.survey_id, round(any_value(x), 6) AS centre_ra, round(any_value(y), 6) AS centre_dec, round(max(sqrt(pow((ra - x) * cos(radians(y)), 2) + pow(dec - y, 2))), 6) AS radius FROM samples JOIN e ON scan_id = e.survey_id GROUP BY e.survey_id""",
)
def daisy_extent(spark: SparkSession, d: str) -> DataFrame:
    """Middle and reach of each user's places, taken as a daisy."""
    motion = levelling.daisy_motion(event_samples(spark, d).withColumn("survey_id", F.col("scan_id")))
    return motion.select("survey_id", *(r6(c).alias(c) for c in ("centre_ra", "centre_dec", "radius")))
