"""Timing offsets between adjacent scans by cross-correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators import rcr


def correlation_lag(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> float:
    """How far the second curve lies ahead of the first, from the peak of their cross-correlation.

    Both are interpolated to one uniform grid of a power of two; lags in the upper half are negative.
    """
    low, high = max(x1.min(), x2.min()), min(x1.max(), x2.max())
    if not high > low:
        return float("nan")
    n = 1 << int(np.ceil(np.log2(max(8, 4 * max(len(x1), len(x2))))))
    grid = np.linspace(low, high, n)
    a, b = np.interp(grid, x1, y1), np.interp(grid, x2, y2)
    a, b = a - a.mean(), b - b.mean()
    peak = int(np.fft.ifft(np.conj(np.fft.fft(a, 2 * n)) * np.fft.fft(b, 2 * n)).real.argmax())
    return (peak if peak < n else peak - 2 * n) * (high - low) / (n - 1)


def period(t: np.ndarray, y: np.ndarray) -> float:
    """Period of the strongest frequency of y over t."""
    n = 1 << int(np.ceil(np.log2(max(8, len(t)))))
    grid = np.linspace(t.min(), t.max(), n)
    v = np.interp(grid, t, y)
    k = int(np.abs(np.fft.rfft(v - v.mean()))[1:].argmax()) + 1
    return (t.max() - t.min()) * n / (n - 1) / k


def adjacent_lags(samples: DataFrame, x: str = "ang_dist", y: str = "flux") -> DataFrame:
    """survey_id, scan_id, lag: shift of the next scan against this one. A scan is sent to its own pair and to the one before."""
    pairs = samples.select("survey_id", "scan_id", x, y, F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("pair", F.col("scan_id") - F.col("side"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == k].sort_values(x) for k in (0, 1))
        lag = correlation_lag(a[x].to_numpy(float), a[y].to_numpy(float), b[x].to_numpy(float), b[y].to_numpy(float)) if len(a) > 2 and len(b) > 2 else float("nan")
        return pd.DataFrame([[pdf["survey_id"].iloc[0], pdf["pair"].iloc[0], lag]])

    out = pairs.groupBy("survey_id", "pair").applyInPandas(run, "survey_id int, scan_id int, lag double")
    return out.filter(~F.isnan("lag"))


def consistent_lags(lags: DataFrame, value: str = "lag", order: str = "scan_id", key: str = "survey_id", out: str = "kept") -> DataFrame:
    """Adds whether a lag agrees with its M neighbours: 2^(M-1) times the product of r (2 - r) over them, where r is
    the difference over the range of all N lags, is at most 1 / 2N. A lag without neighbours is kept."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    spread = F.max(value).over(whole) - F.min(value).over(whole)
    closeness = lambda other: F.when(other.isNull() | (spread == 0), None).otherwise(F.least(F.abs(F.col(value) - other) / spread, F.lit(1.0)))
    r1, r2 = closeness(F.lag(value).over(w)), closeness(F.lead(value).over(w))
    term = lambda r: F.coalesce(r * (2 - r), F.lit(1.0))
    m = r1.isNotNull().cast("int") + r2.isNotNull().cast("int")
    chance = F.when(m > 0, F.pow(F.lit(2.0), m - 1)).otherwise(0.0) * term(r1) * term(r2)
    return lags.withColumn(out, (m == 0) | (chance <= 1.0 / (2.0 * F.count("*").over(whole))))


def survey_shift(lags: DataFrame, speeds: DataFrame) -> DataFrame:
    """survey_id, t_shift: half the robust mean of the lags, signed by scan parity, over the scanning speed."""
    signed = lags.filter("kept").withColumn("signed", F.when(F.col("scan_id") % 2 == 0, F.col("lag")).otherwise(-F.col("lag")))
    mean = rcr.by_group(signed, ["survey_id"], "signed", None, "LS_MODE_DL")
    return mean.join(speeds, "survey_id").select("survey_id", (F.col("mu") / 2 / F.col("speed")).alias("t_shift"))
