"""Joins with a radius a row, convex hulls, and levelling of many surveys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import geometry, levelling, spatial, surface


def test_radius_join_equals_nested_loop(spark):
    rng = np.random.default_rng(4)
    probe = [(k, float(rng.uniform(-30, 30)), float(rng.uniform(-30, 30)), r) for k, r in enumerate([0.0, 1e-9, 0.3, 1.0, 2.0, 2.5, 40.0, 500.0, -1.0, None, 1.0] * 4)]
    build = [(k, float(rng.uniform(-30, 30)), float(rng.uniform(-30, 30))) for k in range(300)] + [(1000 + k, p[1], p[2]) for k, p in enumerate(probe)]
    got = spatial.radius_join(spark.createDataFrame(probe, "p int, px double, py double, r double"), spark.createDataFrame(build, "b int, bx double, by double"), "r", ("px", "py"), ("bx", "by"))
    assert got.columns == ["p", "px", "py", "r", "b", "bx", "by", "distance"]
    want = sorted((p, b) for p, x, y, r in probe if r is not None for b, u, v in build if np.hypot(x - u, y - v) <= r)
    assert sorted((r.p, r.b) for r in got.collect()) == want and len(want) > 500
    empty = spark.createDataFrame([], "p int, px double, py double, r double")
    assert spatial.radius_join(empty, spark.createDataFrame(build, "b int, bx double, by double"), "r", ("px", "py"), ("bx", "by")).count() == 0


def brute_hull(points):
    """Corners by testing every pair of points as a side."""
    p = sorted(set(points))
    if len(p) < 3:
        return set(p)
    corners = set()
    for a in p:
        for b in p:
            if a != b and all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in p):
                corners |= {a, b}
    # points between two others on a side are none
    return {c for c in corners if not any(a != c != b and a != b and (b[0] - a[0]) * (c[1] - a[1]) == (b[1] - a[1]) * (c[0] - a[0]) and min(a, b) < c < max(a, b) for a in corners for b in corners)}


def test_hulls_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    groups = {0: [(float(a), float(b)) for a, b in rng.integers(0, 9, size=(60, 2))], 1: [(1.0, 2.0)] * 5, 2: [(float(k), 2.0 * k) for k in range(6)], 3: [(0.0, 0.0), (3.0, 1.0)], None: [(float(a), float(b)) for a, b in rng.integers(-20, 20, size=(40, 2))]}
    rows = [(g, *p) for g, ps in groups.items() for p in ps] + [(7, None, 1.0), (7, 1.0, float("nan")), (0, None, None)]
    df = spark.createDataFrame(rows, "survey_id int, ra double, dec double").repartition(7)
    for salt in (1, 64):
        got = {r.survey_id: [(c.x, c.y) for c in r.hull] for r in geometry.convex_hulls(df, ["survey_id"], salt=salt).collect()}
        assert {g: set(h) for g, h in got.items()} == {g: brute_hull(p) for g, p in groups.items()}
        for h in got.values():
            assert len(set(h)) == len(h) and h[0] == min(h)
            turns = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in zip(h, h[1:] + h[:1], h[2:] + h[:2])]
            assert len(h) < 3 or min(turns) > 0
    assert geometry.convex_hulls(df.limit(0), ["survey_id"]).count() == 0


def test_pixels_inside_hulls(spark):
    """A nodding's border is its hull: a zigzag that widens leaves out the corners of its box."""
    path = [(0, 0, k, float(k), (-1.0) ** k * k / 2) for k in range(21)] + [(1, 0, 0, 40.0, 0.0), (1, 0, 1, 44.0, 4.0)]
    samples = spark.createDataFrame(path, "survey_id int, scan_id int, sample_id int, ra double, dec double")
    edges = geometry.with_hulls(geometry.footprint(samples), samples)
    grid = surface.pixel_grid(spark, (0.0, 45.0), (-10.0, 10.0), 1.0)
    got = {(r.px, r.py) for r in surface.in_footprint(grid, edges, 2.0, 0.0).collect()}
    want = {(float(x), float(y)) for x in range(21) for y in range(-10, 11) if abs(y) <= x / 2 and not (x == 20 and y < -9.5)}
    # the last stroke ends on top, so the lower border runs from the corner before
    want = {(x, y) for x, y in want if y >= -9.5 + (x - 19) * 19.5 or x < 19}
    assert got == want | {(40.0 + k, float(k)) for k in range(5)}


def test_offsets_of_ten_thousand_surveys(spark):
    """A long chain of overlaps with some across, weights of four orders, and a group apart; each group has mean zero."""
    rng = np.random.default_rng(2)
    n = 10_000
    true = rng.normal(0, 5, n)
    a = np.concatenate([np.arange(n - 101), rng.integers(0, n - 101, 20_000), np.arange(n - 100, n - 1)])
    b = np.concatenate([np.arange(1, n - 100), rng.integers(0, n - 101, 20_000), np.arange(n - 99, n)])
    keep = a != b
    a, b = a[keep], b[keep]
    pdf = pd.DataFrame({"survey_a": a, "survey_b": b, "mu": true[a] - true[b], "sigma": rng.uniform(0.01, 1, len(a)), "n": rng.integers(3, 90, len(a))}).astype({"survey_a": "int32", "survey_b": "int32"})
    pdf.loc[0, "n"] = 50
    pdf = pd.concat([pdf, pd.DataFrame({"survey_a": [1], "survey_b": [2], "mu": [np.nan], "sigma": [1.0], "n": [3]}).astype({"survey_a": "int32", "survey_b": "int32"})])
    got = levelling.survey_offsets(spark.createDataFrame(pdf)).toPandas().sort_values("survey_id").offset.to_numpy()
    main, apart = true[: n - 100], true[n - 100 :]
    assert np.allclose(got, np.concatenate([main - main.mean(), apart - apart.mean()]), atol=1e-4)


def test_levelling_sees_only_samples_inside_the_other_footprint(spark):
    """Survey 1 is a circle; outside it, but near its rim, survey 0 has samples that would shift the difference."""
    rows = [(0, s, k, k * 0.2, s * 0.2, 5.0 + (50.0 if np.hypot(k * 0.2 - 2, s * 0.2 - 2) >= 1.0 else 0.0)) for s in range(21) for k in range(21)]
    rows += [(1, s, k, x, y, 2.0) for s in range(21) for k in range(21) for x, y in [(k * 0.1 + 1.0, s * 0.1 + 1.0)] if np.hypot(x - 2, y - 2) <= 1.0]
    s = spark.createDataFrame(rows, "survey_id int, scan_id int, sample_id int, ra double, dec double, flux double")
    edges = geometry.footprint(s).withColumn("map_type", F.when(F.col("survey_id") == 1, "daisy").otherwise("raster"))
    d = {(r.survey_a, r.survey_b): r.mu for r in levelling.survey_differences(s, 0.8, "flux", edges).collect()}
    assert d[0, 1] == pytest.approx(3.0) and {r.survey_id: r.offset for r in levelling.survey_offsets(levelling.survey_differences(s, 0.8, "flux", edges).filter("survey_a = 0")).collect()} == pytest.approx({0: 1.5, 1: -1.5})
    out = levelling.level(s.filter("flux < 40"), 0.8, "flux").groupBy("survey_id").agg(F.avg("flux").alias("m")).collect()
    assert {round(r.m, 6) for r in out} == {3.5}
