import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import levelling
from starloom.plans import validation
from starloom.sources import fits


def test_levelling_removes_offsets(spark):
    rng = np.random.default_rng(0)
    rows = [(s, k // 20, k % 20, (k % 20) * 0.2 + s * 0.05, (k // 20) * 0.2, 3.0 + off + rng.normal(0, 0.05)) for s, off in ((0, 0.0), (1, 1.0), (2, -0.5)) for k in range(400)]
    s = spark.createDataFrame(pd.DataFrame(rows, columns=["survey_id", "scan_id", "sample_id", "ra", "dec", "flux"]).astype({"survey_id": "int32"}))
    means = [r.m for r in levelling.level(s, 1.0).groupBy("survey_id").agg(F.avg("flux").alias("m")).collect()]
    assert max(means) - min(means) < 0.05
    assert levelling.survey_offsets(levelling.survey_differences(s.filter("survey_id = 0"), 1.0)).count() == 0


def test_spectra_are_cleaned(spark):
    rng = np.random.default_rng(1)
    x = np.arange(80)
    base = 5 + 0.05 * x
    line = 10 * np.exp(-0.5 * ((x - 40) / 1.5) ** 2)
    s = spark.createDataFrame([(1, (base + line + rng.normal(0, 0.1, 80)).tolist())], "row_id int, data array<double>")
    r = levelling.clean_spectra(s, 30.0).first()
    assert abs(r.data[40] - 10) < 1 and np.abs(np.array(r.data[:30])).max() < 0.8


def test_daisy_period(spark):
    t = np.arange(0, 400, 0.5)
    r = np.cos(2 * np.pi * t / 40)
    rows = pd.DataFrame({"survey_id": np.zeros(len(t), "int32"), "t": t, "ra": 100 + r * np.cos(t / 70), "dec": 0 + r * np.sin(t / 70)})
    m = levelling.daisy_motion(spark.createDataFrame(rows)).first()
    assert abs(m.period - 40) < 2.5 and 0.95 < m.radius < 1.1


def test_validation(spark, tmp_path):
    cols = {"UTSECS": np.array([1.0, -1.0, 3.0]), "CRVAL2": np.zeros(3), "CRVAL3": np.zeros(3), "DATA": np.array([[1.0, np.nan, 3.0]] * 3)}
    (tmp_path / "a.fits").write_bytes(fits.table_file({"TELESCOP": "20m", "DATE": "2020-01-01", "OBSMODE": "ralongmap"}, cols))
    rows = validation.validate(spark, str(tmp_path / "a.fits"), 0, 2).orderBy("row_id").collect()
    assert [r.data for r in rows] == [[1.0, None], [1.0, None]]
    (tmp_path / "b.fits").write_bytes(fits.table_file({"TELESCOP": "20m", "DATE": "2012-01-01", "OBSMODE": "ralongmap"}, cols))
    with pytest.raises(ValueError, match="b.fits"):
        validation.validate(spark, str(tmp_path / "b.fits"))
