import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import calibrate, geometry, neighbourhood, photometry, segment, spatial, surface
from starloom.sources import fits, readers, sinks


def raster(spark, flux, n_scans=14, n=40, step=0.25):
    rows = []
    for s in range(n_scans):
        for k in range(n):
            x, y = k * step * 1.0, s * step * 1.5
            rows.append((0, s, k, float(s * 100 + k), x, y, float(flux(x, y)), 1.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["survey_id", "scan_id", "sample_id", "t", "ra", "dec", "flux", "dumps"]).astype({"survey_id": "int32", "scan_id": "int32", "sample_id": "int32"}))


def test_polynomials_are_reproduced(spark):
    f = lambda x, y: 1 + 2 * x - y + 0.3 * x * x - 0.2 * x * y + 0.1 * y * y + 0.01 * x**3
    s = raster(spark, f)
    grid = surface.pixel_grid(spark, (3.0, 6.0), (1.5, 3.0), 0.5)
    near = surface.near_pixels(grid, s, 1.5, "ra", "dec")
    out = surface.surfaces(near, ["x_pix", "y_pix", "px", "py"], "flux", surface.kernel(F.col("distance"), 1.5, 1.0)).toPandas()
    assert (out.terms == 10).all() and len(out) == 28
    assert np.abs(out.flux - f(out.px, out.py)).max() < 1e-6


def test_range_join_equals_cross_join(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame(pd.DataFrame(rng.uniform(-5, 5, (200, 2)), columns=["x", "y"]))
    b = spark.createDataFrame(pd.DataFrame(rng.uniform(-5, 5, (150, 2)), columns=["u", "v"]))
    for reach in (1, 2, 3):
        got = spatial.range_join(a, b, 1.1, ("x", "y"), ("u", "v"), reach=reach).count()
        assert got == a.crossJoin(b).filter("sqrt(pow(x-u,2)+pow(y-v,2)) <= 1.1").count()


def test_spike_goes_and_source_stays(spark):
    rng = np.random.default_rng(5)
    clean = lambda x, y: 8 * np.exp(-0.5 * (((x - 5) / 0.6) ** 2 + ((y - 2.5) / 0.6) ** 2))
    s = raster(spark, lambda x, y: clean(x, y) + rng.normal(0, 0.05)).withColumn("scatter2d", F.lit(0.05))
    s = s.withColumn("flux", F.when((F.col("scan_id") == 3) & (F.col("sample_id") == 30), 50.0).otherwise(F.col("flux")))
    models = neighbourhood.interference_models(s, 0.9)
    out = segment.apply_models(s, models.select("survey_id", "scan_id", "sample_id", "model")).toPandas()
    far = out[(out.scan_id == 3) & (out.sample_id.between(27, 33))]
    assert far.flux.max() < 1.0
    assert out.flux.max() > 4.0


def test_sampling_gap(spark):
    s = raster(spark, lambda x, y: 0.0)
    g = neighbourhood.sampling_gap(s, 1.5).toPandas()
    inner = g[(g.scan_id.between(4, 9)) & (g.sample_id.between(10, 30))]
    assert len(g) == 14 * 40 and inner.theta_gap.nunique() < 20
    assert 0.2 < np.degrees(inner.theta_gap).max() <= 0.75 * 1.5 + 1e-9


def test_gain_is_recovered(spark):
    rng = np.random.default_rng(4)
    rows = []
    for seg, t0, delta in (("pre", 0.0, 2.0), ("post", 1000.0, 3.0)):
        for state in (1, 0):
            rows += [(0, seg, state, t0 + k + 50 * state, 10 + 0.001 * k + delta * state + rng.normal(0, 0.01)) for k in range(40)]
    cal = spark.createDataFrame(rows, "survey_id int, segment string, cal_state int, t double, flux double")
    deltas = calibrate.gain_deltas(cal)
    got = {r.segment: r.delta for r in deltas.collect()}
    assert abs(got["pre"] - 2) < 0.1 and abs(got["post"] - 3) < 0.1
    assert calibrate.drift_test(deltas).first().method == "interpolated"
    scan = spark.createDataFrame([(0, 535.0, 10.0)], "survey_id int, t double, flux double")
    assert abs(calibrate.apply_gain(scan, deltas).first().flux - 10 / 2.5) < 0.1


def test_frames_and_edges(spark):
    s = raster(spark, lambda x, y: 0.0)
    c = geometry.uncentred(geometry.centred(s, 5.0, 40.0), 5.0, 40.0)
    assert c.join(s.selectExpr("scan_id", "sample_id", "ra as r", "dec as d"), ["scan_id", "sample_id"]).filter("abs(ra-r) > 1e-9 or abs(dec-d) > 1e-9").count() == 0
    e = {r.edge: r for r in geometry.edge_lines(s).collect()}
    assert set(e) == {"low", "high", "first", "last"} and abs(e["last"].intercept - 13 * 0.375) < 1e-6


def test_photometry(spark):
    grid = surface.pixel_grid(spark, (0.0, 20.0), (0.0, 20.0), 0.5).withColumns({"weight": F.lit(1.0), "flux": 1.0 + 0.01 * F.sin(F.col("px") * 37 + F.col("py") * 11) + 5 * F.exp(-0.5 * (F.pow(F.col("px") - 10, F.lit(2)) + F.pow(F.col("py") - 10, F.lit(2))))})
    top = photometry.top_sources(grid, 1, 3.0)
    assert top[0][:2] == (10.0, 10.0)
    src = spark.createDataFrame([(1, 10.0, 10.0)], "source_id int, sx double, sy double")
    r = photometry.photometry(grid, src, 4.0, 8.0).first()
    assert abs(r.measured - 5 * 2 * np.pi / 0.25) < 3 and abs(r.mu - 1) < 0.02


def test_fits_round_trip(spark, tmp_path):
    n = 6
    cols = {"UTSECS": np.arange(n) * 1.0, "CRVAL2": np.linspace(150, 151, n), "CRVAL3": np.full(n, 20.0), "AZIMUTH": np.zeros(n), "ELEVATIO": np.ones(n), "NSAMPS": np.full(n, 3.0), "CALSTATE": np.zeros(n, "i4"), "SWPVALID": np.ones(n, "i4"), "SWPINDEX": np.arange(n, dtype="i4"), "CDELT1": np.full(n, 0.5), "DATA": np.arange(n * 4).reshape(n, 4) * 1.0, "OBSFREQ": np.full(n, 1400.0)}
    raw = fits.table_file({"TELESCOP": "20m", "DATE": "2020-01-02", "OBSMODE": "ralongmap"}, cols, history=["START,STOP 2,4", "LOWRES"])
    (tmp_path / "a.fits").write_bytes(raw)
    (tmp_path / "b_validated.fits").write_bytes(raw)
    s = readers.read_sdfits(spark, str(tmp_path / "a.fits")).orderBy("row_id").toPandas()
    # channels 2 to 4 are the ones that the history names
    assert list(s["data"].iloc[2]) == [9.0, 10.0, 11.0] and (s.first_channel == 1).all() and (s.channels == 4).all() and abs(s.ra.iloc[0] - 10) < 1e-12
    h = readers.read_headers(spark, str(tmp_path / "a.fits")).first().header
    assert h["OBSMODE"] == "ralongmap" and "START,STOP 2,4" in h["HISTORY"]
    assert readers.parse_history(h["HISTORY"].split("\n"))["START"] == 2.0
    assert [r.path.split("/")[-1] for r in readers.find_files(spark, str(tmp_path)).collect()] == ["a.fits"]
    assert sinks.remove_validated(str(tmp_path)) == [str(tmp_path / "b_validated.fits")]
    pix = spark.createDataFrame([(0, 0, 1.0, 0.1), (1, 0, 2.0, 0.2), (0, 1, 3.0, 0.3)], "x_pix int, y_pix int, flux double, weight double")
    sinks.write_fits(pix, str(tmp_path / "m.fits"), sinks.map_cards(0.1, 10.0, 20.0, 2, job="x"))
    _, main = fits.image((tmp_path / "m.fits").read_bytes(), 0)
    assert main[0].tolist() == [2.0, 1.0] and np.isnan(main[1, 0])
    assert [r.line for r in sinks.layer_rows(pix, "flux", 2).sort("y_pix").collect()] == ["2.0\t1.0", "3.0"]


def test_text_readers(spark, tmp_path):
    body = "# OBSFREQ= 1400\n# MJD= 58000\n# SCANTYPE RAMAP\n86390 23.9 10 0 1 5 6 1 0 0 1\n5 0.1 10 0 1 5 7 1 0 0 1\n6 0.2\n"
    (tmp_path / "a.txt").write_text(body)
    rows = readers.read_ascii(spark, str(tmp_path / "a.txt")).orderBy("row_id").collect()
    assert [(r.t, round(r.ra, 3), r.flux_r) for r in rows] == [(86390.0, 23.9, 6.0), (86405.0, 24.1, 7.0)]
    assert readers.read_ascii_header(spark, str(tmp_path / "a.txt")).first().frequency == 1.4
    (tmp_path / "f.txt").write_text("1\n20\n5\n*\n2\n20\n4\n**\n3\n21\n7\n4\n21\n8\n")
    got = readers.read_forty(spark, str(tmp_path / "f.txt")).orderBy("row_id").collect()
    assert [(r.t, r.flux_l, r.cal_state, r.sweep) for r in got] == [(1.0, 5.0, 1, -1), (2.0, 4.0, 0, -1), (3.0, 7.0, -1, 0), (4.0, 8.0, -1, 0)]


def test_photometry_correction(spark):
    """A bright source loses little, a faint one more; without interference removal nothing is corrected."""
    grid = surface.pixel_grid(spark, (0.0, 20.0), (0.0, 20.0), 0.5).withColumn("weight", F.lit(1.0))
    noise = 0.01 * F.sin(F.col("px") * 37 + F.col("py") * 11)
    shape = F.exp(-0.5 * (F.pow(F.col("px") - 10, F.lit(2)) + F.pow(F.col("py") - 10, F.lit(2))))
    src = spark.createDataFrame([(1, 10.0, 10.0)], "source_id int, sx double, sy double")
    found = {}
    for height in (0.5, 5.0, 500.0):
        r = photometry.photometry(grid.withColumn("flux", 1.0 + noise + height * shape), src, 4.0, 8.0, beam=2.355, pixel=0.5 / 2.355).first()
        found[height] = r.corrected / r.measured - 1
        assert r.external_error > 0 and abs(r.total_error**2 - (2 * r.internal_error) ** 2 - r.external_error**2) < 1e-6 * r.total_error**2
    assert min(found.values()) > 0 and max(found.values()) < 0.5
    peaks = spark.createDataFrame([(p, 0.01) for p in (1.0, 10.0, 100.0)], "p double, s double")
    factor, spread = photometry.correction(F.col("p"), 0.7, 1.25, F.col("s"), 0.7, 1 / 3, 0.2)
    rows = peaks.select(factor.alias("f"), spread.alias("u")).collect()
    assert rows[0].f > rows[1].f > rows[2].f > 1 and rows[0].u > rows[1].u > rows[2].u > 0
    r = photometry.photometry(grid.withColumn("flux", 1.0 + noise + 5.0 * shape), src, 4.0, 8.0, rfi=0.0).first()
    assert r.corrected == r.measured and r.external_error == 0


def test_detected_sources_equal_brute_force(spark):
    """Two surveys at the same places: each has its own sources."""
    rng = np.random.default_rng(11)
    rows = []
    for survey, centres in ((0, [(3.0, 2.0), (7.0, 3.0), (3.8, 2.2)]), (1, [(3.1, 2.1), (8.0, 1.0)])):
        for s in range(16):
            for k in range(50):
                x, y = k * 0.2, s * 0.25
                f = sum(300 * h * np.exp(-0.5 * (((x - a) / 0.4) ** 2 + ((y - b) / 0.4) ** 2)) for h, (a, b) in enumerate(centres, 1)) + rng.normal()
                rows.append((survey, s, k, x, y, float(f), 1.0))
    pdf = pd.DataFrame(rows, columns=["survey_id", "scan_id", "sample_id", "ra", "dec", "flux", "scatter2d"]).astype({"survey_id": "int32", "scan_id": "int32", "sample_id": "int32"})
    want = []
    for survey, p in pdf.groupby("survey_id"):
        b = p[p.flux >= 75].sort_values(["flux", "scan_id", "sample_id"], ascending=[False, True, True])
        near = [(np.hypot(b.ra - r.ra, b.dec - r.dec) <= 0.8).sum() for r in b.itertuples()]
        chosen = []
        for r, n in zip(b.itertuples(), near):
            if n >= 6 and all(np.hypot(r.ra - q.ra, r.dec - q.dec) > 0.8 for q in chosen):
                chosen.append(r)
        want += [(survey, k, r.scan_id, r.sample_id) for k, r in enumerate(chosen)]
    got = sorted((r.survey_id, r.source_id, r.scan_id, r.sample_id) for r in photometry.detect(spark.createDataFrame(pdf), 0.8).collect())
    assert got == sorted(want) and len(want) >= 4


def test_crowded_cells_are_cut_and_change_nothing(spark):
    """Ten surveys on one place: leaves hold no more than the bound unless they are the smallest, and neighbourhoods are the same."""
    from starloom.operators import neighbourhood

    rng = np.random.default_rng(5)
    rows = [(v, s, k, k * 0.3 + rng.uniform(0, 0.05), s * 0.4 + rng.uniform(0, 0.05), float(rng.normal()), 1.0, 1.0) for v in range(10) for s in range(12) for k in range(14)]
    rows += [(11, 0, k, 40 + 0.3 * k, -7.0, 0.0, 1.0, 1.0) for k in range(20)] + [(12, 0, 0, None, 1.0, 0.0, 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "survey_id int, scan_id int, sample_id int, ra double, dec double, flux double, scatter2d double, dumps double")
    cells = neighbourhood.leaves(samples, 0.5, "ra", "dec", 8).collect()
    smallest = neighbourhood.CELL_RADII * 0.5 / 2**neighbourhood.DEPTH
    assert sum(c.n for c in cells) == len(rows) - 1 and all(c.n <= 8 or c.side == smallest for c in cells)
    assert {c.side for c in cells} >= {smallest, neighbourhood.CELL_RADII * 0.5}
    keys = ["survey_id", "scan_id", "sample_id"]
    found = []
    for crowd in (10**9, 8):
        neighbourhood.CROWD, before = crowd, neighbourhood.CROWD
        try:
            gaps = neighbourhood.sampling_gap(samples, 0.5).orderBy(*keys).toPandas()
            models = neighbourhood.interference_models(samples, 0.5).orderBy(*keys).toPandas()
        finally:
            neighbourhood.CROWD = before
        found.append((gaps, models))
    assert len(found[0][0]) == len(rows) - 1
    for a, b in zip(*found):
        assert (a[keys] == b[keys]).all().all() and np.allclose(a.iloc[:, 3:], b.iloc[:, 3:], equal_nan=True)


def test_local_surfaces_equal_brute_force_and_leave_sources_out(spark):
    """A wide polynomial glow is recovered at every sample, however a narrow source stands in it; coefficients are those of a library's fit."""
    from starloom.operators import local_surface

    rng = np.random.default_rng(12)
    rows = []
    for s in range(14):
        for k in range(18):
            x, y = 0.25 * k, 0.3 * s
            glow = 2 + 0.5 * x - 0.3 * y + 0.1 * x * x + 0.05 * x * y
            rows.append((0, s, k, x, y, float(glow + 8 * np.exp(-0.5 * (((x - 2) / 0.15) ** 2 + ((y - 2.1) / 0.15) ** 2)) + rng.normal(0, 0.02)), glow, 0.05, 1.0 + k % 2, 0.1, 1.0 + 0.25 * (s % 3)))
    names = "survey_id int, scan_id int, sample_id int, ra double, dec double, flux double, glow double, scatter2d double, dumps double, theta_gap double, radius double"
    samples = spark.createDataFrame(rows, names)
    got = local_surface.local_surfaces(samples, 1.5).toPandas().merge(samples.toPandas(), on=["survey_id", "scan_id", "sample_id"])
    assert len(got) == len(rows) and set(got.terms) <= {3, 6, 10} and (got.n_kept < got.n).any()
    assert (got.surface - got.glow).abs().quantile(0.97) < 0.25 and (got.surface - got.glow).abs().median() < 0.03
    # one round, by a library
    one = local_surface.local_surfaces(samples, 1.5, rounds=1).toPandas().set_index(["scan_id", "sample_id"])
    all_ = pd.DataFrame(rows, columns=[n.split()[0] for n in names.split(", ")])
    for r in all_.iloc[::17].itertuples():
        d = np.hypot(all_.ra - r.ra, all_.dec - r.dec)
        p = all_[d < r.radius].assign(d=d)
        half = max(2 * r.radius / 3, 4 / 3 * 0.1)
        w = (p.dumps * np.cos(np.pi * p.d / (2 * r.radius)) ** (-np.log(2) / np.log(np.cos(np.pi * half / (4 * r.radius))))).to_numpy()
        for last in (False, True):
            n = p.groupby("scan_id").size()
            terms = 10 if len(n) >= 5 and n.max() >= 5 and len(p) >= 10 else 6 if len(n) >= 4 and n.max() >= 4 and len(p) >= 6 else 3
            a = np.column_stack([(p.ra - r.ra) ** i * (p.dec - r.dec) ** j for i, j in local_surface.TERMS[:terms]])
            c = np.linalg.lstsq(a * np.sqrt(w)[:, None], p.flux * np.sqrt(w), rcond=None)[0]
            far = w * (p.flux - a @ c) ** 2
            free = w.sum() - terms * (w**2).sum() / w.sum()
            if last or free <= 0 or np.sqrt(far.sum() / free) <= 0.05:
                break
            keep = np.arange(len(p)) != int(far.to_numpy().argmax())
            p, w = p[keep], w[keep]
        mine = one.loc[(r.scan_id, r.sample_id)]
        assert mine.n_kept == len(p) and mine.terms == terms and np.allclose(mine.coefficients, c, atol=1e-6)
        # across a scan along x the curvature is that of y
        assert mine.curvature == pytest.approx(2 * c[local_surface.TERMS.index((0, 2))] if terms > 3 else 0.0, abs=1e-6)


def test_search_radius_follows_the_scan(spark):
    from starloom.operators import local_surface

    s = spark.createDataFrame([(0, 0, k, float(k)) for k in range(11)], "survey_id int, scan_id int, sample_id int, ang_dist double")
    got = [r.r for r in s.withColumn("r", local_surface.search_radius(2.0, 9.0)).orderBy("sample_id").collect()]
    assert got == pytest.approx([max(min(6.0, 2 * max(k, 10 - k) / 3), 2.0) for k in range(11)])
