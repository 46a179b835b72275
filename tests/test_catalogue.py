import duckdb
import numpy as np
import pytest
from compare import rows, sql_rows

from starloom.operators import calibrate, rcr
from starloom.operators.timeshift import correlation_lag
from starloom.plans.queries import ORACLES, QUERIES
from starloom.sources.adapter import EVENT_SAMPLES

ITERATIVE = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf)) == sql_rows(ORACLES[name], sf)


@pytest.fixture(scope="module")
def scans(sf):
    """The events as scans, from DuckDB, each in the order of its samples."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    s = con.execute(f"WITH {EVENT_SAMPLES} SELECT * FROM samples ORDER BY scan_id, sample_id").df()
    return {k: p.reset_index(drop=True) for k, p in s.groupby("scan_id")}


def collected(spark, sf, name, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in QUERIES[name](spark, sf).collect()}


def test_rejection_queries_equal_direct_calls(spark, sf, scans):
    """Every scan of the iterative queries against the function called on arrays from DuckDB."""
    flags, single, line, noise = (collected(spark, sf, *x) for x in (("rcr_flags", "scan_id", "sample_id"), ("rcr_single", "scan_id"), ("rcr_line", "scan_id"), ("scan_scatter", "scan_id")))
    assert len(flags) == sum(map(len, scans.values())) and set(single) == set(line) == set(noise) == set(scans)
    for k, p in scans.items():
        y, w, x = (p[c].to_numpy(float) for c in ("flux", "dumps", "sample_id"))
        assert [flags[k, i].kept for i in p.sample_id] == rcr.reject(y, w, "LS_MODE_DL").flags.tolist()
        r = rcr.reject(y, w, "SS_MEDIAN_DL")
        assert (single[k].n, single[k].n_kept) == (len(y), r.flags.sum()) and single[k].mu == pytest.approx(r.mu, nan_ok=True) and single[k].stdev == pytest.approx(r.stdev, nan_ok=True)
        m = rcr.LinearModel(x, y, w)
        r = rcr.reject(y, w, "LS_MODE_68", True, m)
        m(r.flags)
        assert line[k].n_kept == r.flags.sum() and (line[k].slope, line[k].intercept) == pytest.approx((m.slope, m.intercept - m.slope * m.x0), rel=1e-6, abs=1e-6)
        r = rcr.reject(y, w, "SS_MEDIAN_DL", False, rcr.neighbour_residuals(p.t.to_numpy(float), y))
        assert noise[k].scatter == pytest.approx(calibrate.POINT_FACTOR * r.sigma, nan_ok=True) and noise[k].clean_dumps == w[r.flags].sum()


def test_scan_queries_equal_direct_calls(spark, sf, scans):
    base, lags = collected(spark, sf, "background_model", "scan_id", "sample_id"), collected(spark, sf, "time_shift", "scan_id")
    for k, p in scans.items():
        if k + 1 in scans and len(p) > 2 and len(scans[k + 1]) > 2:
            a, b = (q.sort_values("ra") for q in (p, scans[k + 1]))
            lag = correlation_lag(*(x[c].to_numpy(float) for x in (a, b) for c in ("ra", "flux")))
            assert k not in lags if np.isnan(lag) else lags[k].lag == pytest.approx(lag, abs=0.06)
    assert set(base) == {(k, i) for k, p in scans.items() for i in p.sample_id}


@pytest.mark.parametrize("name", [n for n in ITERATIVE if n not in ("rcr_flags", "rcr_single", "rcr_line", "scan_scatter", "background_model", "time_shift")])
def test_iterative_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
