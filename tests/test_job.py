from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from starloom.plans import config, mapping
from starloom.streaming.ingest import ingest


def raw_survey(spark):
    """Calibration before and after (height 2), 15 sweeps over a source of height 4 on a drift, gain 2."""
    rng = np.random.default_rng(8)
    rows, t = [], 0.0

    def add(ra, dec, flux, state, sweep, valid):
        nonlocal t
        rows.append((0, len(rows), t, ra / 15, dec, 0.0, 45.0, flux, flux, 1.0, state, sweep, valid))
        t += 1.0

    for k in range(2):
        for state in (1, 0):
            for _ in range(20):
                add(10.0, 0.0, 5 + 2.0 * state + rng.normal(0, 0.01), state, 0, 0)
        if k == 0:
            for s in range(15):
                for j in range(40):
                    ra, dec = 10 + j * 0.2, s * 0.35
                    f = 4 * np.exp(-0.5 * (((ra - 14) / 0.4) ** 2 + ((dec - 2.45) / 0.4) ** 2)) + 0.3 * j * 0.2 + 1 + rng.normal(0, 0.3)
                    add(ra, dec, 2 * f, -1, s, 1)
    names = "survey_id row_id t ra dec az el flux_l flux_r dumps cal_state sweep valid".split()
    types = {c: "int32" for c in ("survey_id", "cal_state", "sweep", "valid")}
    return spark.createDataFrame(pd.DataFrame(rows, columns=names).astype(types))


def test_planted_source_is_mapped(spark):
    job = config.Job(background_scale=4.0, rfi_scale=0.7, time_shift="off", pixel_scale=0.25, photometry=True)
    out = mapping.run(spark, raw_survey(spark), job, beam=1.0)
    m = out["map"].toPandas()
    top = m.loc[m.flux.idxmax()]
    assert abs(top.px - 14) < 0.5 and abs(top.py - 2.45) < 0.5
    assert 2 < top.flux < 5.5
    far = m[(m.px < 12) & m.flux.notna()]
    assert far.flux.abs().median() < 0.5
    assert {"weight", "weight2", "scale", "correlation", "gap", "path", "terms"} <= set(m.columns)
    assert out["sources"].count() == 1
    prepared = mapping.prepare(mapping.scans(raw_survey(spark), job), job, 1.0, (0.0, 0.0))
    detected = mapping.source_table(out["map"], replace(job, centroid="detected", detect_limit=5.0), 1.0, prepared)
    (r,) = detected.collect()
    assert abs(r.ra_pix - 14) < 0.5 and abs(r.dec_pix - 2.45) < 0.5 and r.measured > 0
    # the smooth surface follows the drift that the background took, and keeps the source out
    wide = mapping.smoothed(prepared, job, 1.0).toPandas()
    drift = (0.3 * (wide.ra - 10) + 1) - wide.flux
    assert drift.abs().median() < 0.3 and wide.flux.max() < 4.5 and wide.scatter2d.gt(0).all() and wide.elevation_scatter.notna().any()


def test_settings(tmp_path):
    (tmp_path / "job.toml").write_text('[input]\nfilenames = ["a.fits", "b.fits"]\n[map]\nchannel = "left"\nrfi_scale = 0.7\ninclude = [1355, 1435]\n')
    job = config.load(str(tmp_path / "job.toml"))
    assert job.filenames == ("a.fits", "b.fits") and job.include == ((1355.0, 1435.0),) and job.channel == "left"
    assert config.from_arguments(["a.fits", "--rfi-scale", "0.4", "--raw-map", "--exclude", "1", "2"]).exclude == ((1.0, 2.0),)
    assert config.from_mapping({"preset": "bright"}).rfi_scale == config.PRESETS["bright"]
    for bad in ({"channel": "up"}, {"rfi_scale": -1.0}, {"include": [[3, 2]]}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)


def test_ingest_takes_each_file_once(spark, tmp_path):
    from test_sky import fits

    cols = {"UTSECS": np.arange(3) * 1.0, "CRVAL2": np.zeros(3), "CRVAL3": np.zeros(3), "DATA": np.ones((3, 2))}
    raw = fits.table_file({"TELESCOP": "20m"}, cols)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.fits").write_bytes(raw)
    for n in (3, 3, 6):
        if n == 6:
            (src / "b.fits").write_bytes(raw)
        ingest(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
