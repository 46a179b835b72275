"""Planted skies of every kind of observation through the whole job."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom import __main__ as command
from starloom.operators import calibrate, geometry, segment, spatial
from starloom.plans import config, mapping
from starloom.sources import fits, readers
from test_job import raw_survey

NAMES = "survey_id row_id t ra dec az el flux_l flux_r dumps cal_state sweep valid".split()
INTS = {c: "int32" for c in ("survey_id", "cal_state", "sweep", "valid")}


def daisy(n_petals=16, step=0.25, period=20.0, centre=(150.0, 30.0), radius=3.0):
    """A source of height 6, half a degree (on the sky) from the middle of a daisy."""
    rng = np.random.default_rng(3)
    t = np.arange(0, n_petals * period, step)
    r, turn = radius * np.cos(np.pi * t / period), t / (n_petals * period) * np.pi
    x, y = r * np.cos(turn), r * np.sin(turn)
    f = 6 * np.exp(-0.5 * (((x - 0.5) / 0.4) ** 2 + ((y + 0.3) / 0.4) ** 2)) + rng.normal(0, 0.1, len(t))
    ra = (centre[0] + x / np.cos(np.radians(centre[1]))) / 15
    cols = [0, np.arange(len(t)), t, ra, centre[1] + y, 0.0, 45.0, f, f, 1.0, -1, 0, 1]
    return pd.DataFrame(dict(zip(NAMES, cols))).astype(INTS)


def test_petals_are_cut_at_their_farthest_points(spark):
    raw = daisy()
    s = spark.createDataFrame(raw).withColumn("ra", F.col("ra") * 15)
    motion = spark.createDataFrame([(0, 150.0, 30.0, 40.0, 3.0)], "survey_id int, centre_ra double, centre_dec double, period double, radius double")
    got = segment.split_daisy(s, motion).groupBy("scan_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("scan_id").toPandas()
    assert len(got) == 16
    # farthest points are at whole periods; windows begin half a petal after the first sample
    assert np.abs(got.a.to_numpy()[1:] - 20.0 * np.arange(1, 16)).max() <= 0.25
    assert segment.split_daisy(s, motion).count() == len(raw)


def test_daisy_is_mapped(spark):
    job = config.Job(pattern="daisy", calibration="none", background_scale=0.0, rfi_scale=0.0, time_shift="off", pixel_scale=0.2, trim=0.5, photometry=True, large_scale=True)
    out = mapping.run(spark, spark.createDataFrame(daisy()), job, beam=1.0)
    m = out["map"].toPandas()
    top = m.loc[m.flux.idxmax()]
    assert abs((top.ra - 150) * np.cos(np.radians(30)) - 0.5) < 0.3 and abs(top.dec - 29.7) < 0.3
    assert 4.5 < top.flux < 7
    # the footprint is a circle
    cx, cy = (m.px.min() + m.px.max()) / 2, (m.py.min() + m.py.max()) / 2
    assert np.hypot(m.px - cx, m.py - cy).max() < 2.7
    source = out["sources"].first()
    assert abs((source.ra_pix - top.px)) < 0.4 and abs(source.dec_pix - 29.7) < 0.2
    assert "large_scale" in out


def test_drift_scans_of_two_files_are_mapped(spark, tmp_path):
    rng = np.random.default_rng(6)
    left, right = [], []
    for state in (1, 0):
        for k in range(12):
            left.append(f"{k}\n10\n{5 + 2 * state + rng.normal(0, 0.01)}")
            right.append(f"{k}\n10\n{9 + 4 * state + rng.normal(0, 0.01)}")
        left.append("**" if state == 0 else "*")
        right.append("**" if state == 0 else "*")
    for scan in range(12):
        for j in range(40):
            t, dec = 1000 + 60 * j, 10 + 0.35 * scan
            f = 4 * np.exp(-0.5 * ((((t / 240) - 9) / 0.5) ** 2 + ((dec - 12.1) / 0.5) ** 2)) + 1
            left.append(f"{t}\n{dec + rng.normal(0, 0.01)}\n{2 * (f + rng.normal(0, 0.05))}")
            right.append(f"{t}\n{dec}\n{4 * (f + rng.normal(0, 0.05))}")
        left.append("*")
        right.append("*")
    for name, lines in (("l.txt", left), ("r.txt", right)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    raw = readers.read_observations(spark, [str(tmp_path / "l.txt"), str(tmp_path / "r.txt")], "40ft", paired=True)
    samples = mapping.scans(raw, config.Job(pattern="drift", calibration="pre")).toPandas()
    # the noise signal is 2 in the left channel and 4 in the right one: each is divided by its own
    assert samples.scan_id.nunique() == 12 and abs(samples.flux.median() - 1) < 0.1 and samples.flux.max() > 4
    job = config.Job(pattern="drift", calibration="pre", background_scale=0.0, rfi_scale=0.0, time_shift="off", pixel_scale=0.25)
    m = mapping.run(spark, raw, job, beam=1.0)["map"].toPandas()
    top = m.loc[m.flux.idxmax()]
    assert abs(top.ra - 9) < 0.4 and abs(top.dec - 12.1) < 0.4


def test_receivers(spark):
    """Four rows a sample, two receivers; the higher frequency comes second."""
    rows = [(0, "f", k, float(k // 4), 0.0, 0.0, 0.0, 0.0, 1.0, -1, 0, 1, 0.0, 1000.0 + 500.0 * (k % 2), [10.0 * (k % 4) + 100 * (k // 4)]) for k in range(8)]
    s = spark.createDataFrame(rows, "survey_id int, path string, row_id long, t double, ra double, dec double, az double, el double, dumps double, cal_state int, sweep int, valid int, cdelt double, obs_freq double, data array<double>")
    got = lambda f, receiver: [(r.row_id, r.t, r.flux_r, r.flux_l) for r in mapping.integrate(f, config.Job(receiver=receiver)).orderBy("row_id").collect()]
    assert got(s, "hi") == [(0, 0.0, 10.0, 30.0), (1, 1.0, 110.0, 130.0)]
    assert got(s, "lo") == [(0, 0.0, 0.0, 20.0), (1, 1.0, 100.0, 120.0)]
    pairs = s.withColumn("obs_freq", F.lit(1000.0)).filter("row_id < 6")
    assert got(pairs, "hi") == [(0, 0.0, 0.0, 10.0), (1, 0.0, 20.0, 30.0), (2, 1.0, 100.0, 110.0)]


def test_gains(spark):
    deltas = spark.createDataFrame([(0, "pre", 2.0, 0.1, 0.0), (0, "post", 2.1, 0.1, 10.0), (1, "pre", 2.0, 0.01, 0.0), (1, "post", 3.0, 0.01, 10.0)], "survey_id int, segment string, delta double, delta_error double, t double")
    s = spark.createDataFrame([(i, 5.0, 10.0) for i in (0, 1, 2)], "survey_id int, t double, flux double")
    got = {r.survey_id: r.flux for r in calibrate.apply_gain(s, deltas, "auto").collect()}
    # no drift in survey 0 (also 2.05 at half time); survey 1 drifts; survey 2 has no calibration
    assert abs(got[0] - 10 / 2.05) < 1e-12 and got[1] == 10 / 2.5 and got[2] == 10
    early = s.withColumn("t", F.lit(0.0))
    got = {r.survey_id: r.flux for r in calibrate.apply_gain(early, deltas, "auto").collect()}
    assert abs(got[0] - 10 / 2.05) < 1e-12 and got[1] == 5
    over = calibrate.overridden(deltas, s, 4.0, -999.0)
    got = {(r.survey_id, r.segment): r.delta for r in over.collect()}
    assert got == {(0, "pre"): 4.0, (0, "post"): 2.1, (1, "pre"): 4.0, (1, "post"): 3.0, (2, "pre"): 4.0}


def test_slanted_footprint_and_gaps_equal_brute_force(spark):
    """Two surveys, one scanned along each axis, with slanted borders."""
    rows = []
    for survey, in_ra in ((0, True), (1, False)):
        for s in range(12):
            for k in range(30):
                across, along = 0.5 * s + 0.1 * k * 0.2, 0.1 * k + 0.08 * s
                x, y = (along, across) if in_ra else (across + 1, along)
                rows.append((survey, s, k, x, y, 0.1 * k * (1 + survey)))
    pdf = pd.DataFrame(rows, columns=["survey_id", "scan_id", "sample_id", "ra", "dec", "ang_dist"]).astype({"survey_id": "int32", "scan_id": "int32", "sample_id": "int32"})
    s = spark.createDataFrame(pdf)
    directions = geometry.scan_direction(s)
    assert {r.survey_id: r.scans_in_ra for r in directions.collect()} == {0: True, 1: False}
    lines = geometry.edge_lines(s.join(directions, "survey_id"), F.col("scans_in_ra"))
    edges = geometry.with_lines(geometry.footprint(s), lines, directions)

    def inside(survey, x, y):
        across, along = (y, x) if survey == 0 else (x - 1, y)
        # low ends: k = 0; high ends: k = 29; first and last scan: s = 0 and 11
        low = 0.08 * (across / 0.5)
        high = 2.9 + 0.08 * ((across - 0.58) / 0.5)
        first, last = 0.2 * along, 5.5 + 0.2 * (along - 0.88)
        return low < along < high and first < across < last

    rng = np.random.default_rng(1)
    points = pd.DataFrame({"px": rng.uniform(-0.5, 8, 800), "py": rng.uniform(-0.5, 8, 800)})
    crossed = spark.createDataFrame(points).crossJoin(F.broadcast(edges))
    got = crossed.filter(spatial.inside_survey(F.col("px"), F.col("py"), 0.0, True)).select("survey_id", "px", "py").toPandas()
    want = {(v, p.px, p.py) for v in (0, 1) for p in points.itertuples() if inside(v, p.px, p.py)}
    assert set(got.itertuples(index=False, name=None)) == want and len(want) > 50
    gaps = {r.survey_id: r.gap for r in geometry.gap_threshold(s).collect()}
    assert abs(gaps[0] - 0.1) < 1e-9 and abs(gaps[1] - 0.2) < 1e-9
    least = geometry.least_gap(s, edges, geometry.gap_threshold(s)).toPandas()
    for r in least[(least.survey_id == 1) & least.scan_id.between(1, 10) & least.sample_id.between(1, 28)].itertuples():
        assert abs(r.min_gap - (0.1 if inside(0, r.ra, r.dec) else 0.2)) < 1e-9
    assert np.allclose(least[least.survey_id == 0].min_gap, 0.1)


@pytest.mark.parametrize("coordinates", ["equatorial", "galactic"])
def test_named_places_and_far_declinations(spark, coordinates):
    """At 60 degrees a degree of right ascension is half a degree on the sky."""
    shifted = raw_survey(spark).withColumns({"ra": (F.col("ra") * 15 - 14) / F.cos(F.radians(F.lit(60.0))) / 15 + 10, "dec": F.col("dec") + 57.55})
    job = config.Job(background_scale=0.0, rfi_scale=0.0, time_shift="off", pixel_scale=0.25, coordinates=coordinates)
    m = mapping.run(spark, shifted, job, beam=1.0)["map"]
    top = m.filter("not isnan(flux)").orderBy(F.desc("flux")).first()
    want = (150.0, 60.0)
    if coordinates == "galactic":
        sky = spark.createDataFrame([want], "ra double, dec double")
        want = tuple(geometry.to_galactic(sky).first())
    assert abs((top.ra - want[0]) * np.cos(np.radians(want[1]))) < 0.5 and abs(top.dec - want[1]) < 0.5
    if coordinates == "equatorial":
        named = config.Job(**{**job.__dict__, "centroid": "coordinates", "places": ((150.4, 60.2),)})
        found = mapping.source_table(m, named, 1.0).first()
        assert abs(found.ra_pix - top.px) < 0.5 and abs(found.dec_pix - top.py) < 0.5


def test_command_line_writes_fits(spark, tmp_path):
    raw = raw_survey(spark).orderBy("row_id").toPandas()
    two = raw.loc[raw.index.repeat(2)].reset_index(drop=True)
    cols = {"UTSECS": two.t.to_numpy(), "CRVAL2": two.ra.to_numpy() * 15, "CRVAL3": two.dec.to_numpy(), "AZIMUTH": two.az.to_numpy(), "ELEVATIO": two.el.to_numpy(), "NSAMPS": two.dumps.to_numpy(), "CALSTATE": two.cal_state.to_numpy("i4"), "SWPINDEX": two.sweep.to_numpy("i4"), "SWPVALID": two.valid.to_numpy("i4"), "CDELT1": np.full(len(two), 0.5), "OBSFREQ": np.full(len(two), 1400.0), "DATA": np.stack([two.flux_l.to_numpy() / 2] * 2, axis=1)}
    (tmp_path / "a.fits").write_bytes(fits.table_file({"TELESCOP": "20m", "DATE": "2020-01-02", "OBSMODE": "ralongmap", "OBSFREQ": 1400.0}, cols))
    assert readers.describe(spark, str(tmp_path / "a.fits")) == {"telescope": "20m", "frequency": 1.4, "map_type": "raster"}
    command.main([str(tmp_path / "a.fits"), "--output", str(tmp_path / "out"), "--fits", "--text", "--validate", "--background-scale", "0", "--rfi-scale", "0", "--time-shift", "off", "--pixel-scale", "0.25"])
    written = spark.read.parquet(str(tmp_path / "out/map"))
    top = written.filter("not isnan(flux)").orderBy(F.desc("flux")).first()
    assert abs(top.ra - 14) < 0.5 and abs(top.dec - 2.45) < 0.5
    lines = [x.value for x in spark.read.text(str(tmp_path / "out/map-text/flux")).collect()]
    assert len(lines) == written.agg(F.max("y_pix")).first()[0] + 1 - written.agg(F.min("y_pix")).first()[0] and max(float(v) for x in lines for v in x.split("\t") if v != "nan") == pytest.approx(top.flux)
    assert (tmp_path / "out/validated/a_validated.fits").exists()
    head, data = fits.image((tmp_path / "out/map.fits").read_bytes(), 0)
    assert head["RCPATRN"] == "raster" and np.isclose(np.nanmax(data), top.flux)
    row, col = np.unravel_index(np.nanargmax(data), data.shape)
    assert abs(head["CRVAL2"] + (row + 1 - head["CRPIX2"]) * head["CDELT2"] - top.dec) < 1e-6
    assert abs(head["CRVAL1"] + (col + 1 - head["CRPIX1"]) * head["CDELT1"] - top.ra) < 0.02


def test_nodding_is_mapped(spark):
    """Strokes up and down over a source, with a border that is their hull."""
    rng = np.random.default_rng(9)
    rows, t = [], 0.0
    for stroke in range(24):
        for k in range(30):
            up = k if stroke % 2 == 0 else 29 - k
            ra, dec = 10 + 0.2 * stroke + 0.2 * k / 29, 0.15 * up
            rows.append((0, len(rows), t, ra / 15, dec, 0.0, 45.0, *[5 * np.exp(-0.5 * (((ra - 12.6) / 0.4) ** 2 + ((dec - 2.1) / 0.4) ** 2)) + rng.normal(0, 0.1)] * 2, 1.0, -1, stroke, 1))
            t += 1
    raw = spark.createDataFrame(pd.DataFrame(rows, columns=NAMES).astype(INTS))
    job = config.Job(pattern="nodding", calibration="none", background_scale=0.0, rfi_scale=0.0, time_shift="off", pixel_scale=0.25)
    m = mapping.run(spark, raw, job, beam=1.0)["map"].toPandas()
    top = m.loc[m.flux.idxmax()]
    assert abs(top.ra - 12.6) < 0.4 and abs(top.dec - 2.1) < 0.4 and 3.5 < top.flux < 6.5
    assert m.py.min() >= 0 and m.py.max() <= 4.35 + 1e-9 and len(m) > 200


def test_daisy_motion_equals_the_transform_of_all_samples(spark, monkeypatch):
    from starloom.operators import levelling
    from starloom.operators.timeshift import period

    raw = pd.concat([daisy().assign(ra=lambda d: d.ra * 15), daisy(period=13.0, centre=(20.0, -40.0)).assign(ra=lambda d: d.ra * 15, survey_id=1)]).astype({"survey_id": "int32"})
    for bins in (levelling.TIME_BINS, 512):
        monkeypatch.setattr(levelling, "TIME_BINS", bins)
        for r in levelling.daisy_motion(spark.createDataFrame(raw).repartition(5)).collect():
            p = raw[raw.survey_id == r.survey_id]
            x, y = (p.ra.min() + p.ra.max()) / 2, (p.dec.min() + p.dec.max()) / 2
            far = np.hypot((p.ra - x) * np.cos(np.radians(y)), p.dec - y)
            assert (r.centre_ra, r.centre_dec, r.radius) == pytest.approx((x, y, far.max()))
            assert r.period == pytest.approx(2 * period(p.t.to_numpy(), far.to_numpy()), rel=1e-6 if bins > 2000 else 5e-3)


def test_stray_scans_do_not_enlarge_a_map(spark):
    rows = [(0, s, k, 10 + 0.2 * k + 0.02 * s, 0.3 * s) for s in range(14) for k in range(30)]
    whole = geometry.robust_bounds(spark.createDataFrame(rows, "survey_id int, scan_id int, sample_id int, ra double, dec double"))
    assert whole == pytest.approx((10.0, 10 + 0.2 * 29 + 0.26, 0.0, 3.9))
    stray = [*rows, (0, 14, 0, 90.0, 4.2), (0, 14, 1, 13.0, 4.2), (0, 15, 0, 12.0, -70.0), (0, 15, 1, 13.0, 4.5)]
    bounds = geometry.robust_bounds(spark.createDataFrame(stray, "survey_id int, scan_id int, sample_id int, ra double, dec double"))
    assert 10 - 1 < bounds[0] <= 10.0 and bounds[1] < 20 and -5 < bounds[2] <= 0.0 and 3.9 <= bounds[3] < 6
    assert geometry.robust_bounds(spark.createDataFrame([], "survey_id int, scan_id int, sample_id int, ra double, dec double")) is None


def test_models_on_more_places_and_header_bands(spark):
    from starloom.operators import neighbourhood

    rng = np.random.default_rng(3)
    rows = [(0, s, k, 0.2 * k, 0.2 * s, float(rng.normal(0, 0.1) + (6 if (s, k) == (4, 5) else 0)), 0.1, 1.0) for s in range(10) for k in range(12)]
    samples = spark.createDataFrame(rows, "survey_id int, scan_id int, sample_id int, ra double, dec double, flux double, scatter2d double, dumps double")
    none = neighbourhood.interference_models(samples, 0.7).toPandas()
    places = spark.createDataFrame([(1.0, 0.8), (1.1, 0.9), (50.0, 50.0)], "mx double, my double")
    more = neighbourhood.interference_models(samples, 0.7, extra=places).toPandas()
    both = none.merge(more, on=["survey_id", "scan_id", "sample_id"])
    assert len(both) == len(none) == len(more)
    far = np.hypot(0.2 * both.sample_id - 1.05, 0.2 * both.scan_id - 0.85) > 0.9
    assert np.allclose(both.model_x[far], both.model_y[far]) and (both.gm_weight_x != both.gm_weight_y)[~far].any()
    assert readers.frequency_range({"OBSFREQ": "1400", "OBSBW": "80"}, {}) == (1360.0, 1440.0)
    assert readers.frequency_range({"OBSFREQ": "1400", "OBSBW": "80"}, readers.parse_history(["RFFILTER 1370,1500"])) == (1370.0, 1440.0)
    sources = spark.createDataFrame([(5.0, 5.0)], "ra double, dec double")
    assert neighbourhood.extra_models(sources, 1.0, 0.2, 0.1).count() == 0
    grid = neighbourhood.extra_models(sources, 1.0, 0.7, 0.1).toPandas()
    assert len(grid) > 8 and (np.hypot(grid.mx - 5, grid.my - 5) <= 2 * (1 - 0.49) + 1e-9).all()


def test_many_files_are_one_plan_and_channels_are_cut(spark, tmp_path):
    def write(name, k, history=()):
        cols = {"UTSECS": np.arange(3) + 10.0 * k, "CRVAL2": np.full(3, 30.0), "CRVAL3": np.zeros(3), "ELEVATIO": np.full(3, 45.0), "NSAMPS": np.ones(3), "OBSFREQ": np.full(3, 1400.0), "CDELT1": np.full(3, 1e6), "DATA": np.arange(24.0).reshape(3, 8) + k}
        (tmp_path / name).write_bytes(fits.table_file({"TELESCOP": "20m"}, cols, history=list(history)))
        return str(tmp_path / name)

    paths = [write(f"f {k}.fits", k) for k in range(40)]
    few, many = (readers.read_observations(spark, p) for p in (paths[:2], paths))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(few) == plan(many)
    assert sorted((r.survey_id, r.t) for r in many.select("survey_id", "t").collect()) == [(k, 10.0 * k + j) for k in range(40) for j in range(3)]
    with pytest.raises(ValueError):
        readers.read_observations(spark, paths[:1] * 2)
    with pytest.raises(ValueError):
        readers.read_observations(spark, [str(tmp_path / "x.dat")])
    cut = write("cut.fits", 0, ["START,STOP channels [3, 6]"])
    r = readers.read_observations(spark, [cut]).orderBy("row_id").first()
    assert (r.first_channel, r.channels, r.data) == (2, 8, [2.0, 3.0, 4.0, 5.0])
    # the channel at 1401 MHz is the same one, cut or not
    band = config.Job(include=((1400.5, 1401.5),))
    flux = [mapping.integrate(readers.read_observations(spark, [p]), band).orderBy("row_id").first().flux_r for p in (paths[0], cut)]
    assert flux[0] == flux[1] == 4.0
    # validated copies are read like the files they come from
    from starloom.plans import validation
    from starloom.sources import sinks

    made = {r.path: r.written for r in sinks.write_validated(validation.validate(spark, [*paths[:2], cut]), str(tmp_path / "ok")).collect()}
    assert sorted(made.values()) == [str(tmp_path / "ok" / f"{n}_validated.fits") for n in ("cut", "f 0", "f 1")] and len(list((tmp_path / "ok").iterdir())) == 3
    names = ["t", "ra", "dumps", "first_channel", "channels", "data"]
    both = [readers.read_observations(spark, [p]).orderBy("row_id").select(*names).collect() for p in (cut, made[readers.qualified(spark, cut)])]
    assert both[0] == both[1]
