"""Interference models fitted in step against plain loops over samples."""

import numpy as np
import pandas as pd
import pytest

from starloom.operators import neighbourhood, rcr
from starloom.operators.neighbourhood import local_fit


def surviving(d, z, w, scatter, radius):
    """Kept flags and model values: the most positive outlier goes until the mean square above equals the scatter; both signs where f <= 0."""
    kept = np.ones(len(d), dtype=bool)
    values = np.zeros(len(d))
    for _ in range(len(d)):
        f, g, p = local_fit(d[kept], z[kept], w[kept], radius)
        values = f * np.cos(np.pi * d / (2 * radius)) ** 2 + g
        r = z - values
        side = kept & ((r > 0) if f > 0 else np.ones(len(d), bool))
        if kept.sum() <= 3 or not side.any():
            break
        if np.sqrt((w[side] * r[side] ** 2).sum() / w[side].sum()) <= scatter:
            break
        score = np.where(side, r if f > 0 else np.abs(r), -np.inf)
        kept[int(score.argmax())] = False
    return kept, values


def plain_models(p, radius, places=()):
    """Rows of (model, gm_weight, correlation) by sample."""
    x, y, z, w0, noise = (p[c].to_numpy(float) for c in ("ra", "dec", "flux", "dumps", "scatter2d"))
    given = [[] for _ in range(len(p))]
    for mx, my in [*zip(x, y), *places]:
        d = np.hypot(x - mx, y - my)
        at = np.flatnonzero(d < radius)
        if not len(at):
            continue
        d, w = d[at], w0[at] / np.maximum(noise[at], 1e-12) ** 2
        kept, value = surviving(d, z[at], w, float(noise[at].mean()), radius)
        q = np.cos(np.pi * d / (2 * radius)) ** 2
        mean = np.average(q[kept], weights=w[kept])
        var = max(np.average((q[kept] - mean) ** 2, weights=w[kept]), 1e-12)
        local = w0[at][kept].sum() / (1 + 2 * (q - mean) ** 2 / var)
        square = float((w[kept] * d[kept] ** 2).sum() / w[kept].sum())
        for k in np.flatnonzero(kept):
            given[at[k]].append((value[k], local[k], int(kept.sum()), square))
    out = []
    for g in given:
        if not g:
            out.append(None)
            continue
        unit = 2.0 ** (np.ceil(np.log2(max(abs(v[0]) for v in g))) - 30)
        v, w, n, square = (np.array(c) for c in zip(*sorted((round(v[0] / unit) * unit, *v[1:]) for v in g)))
        r = rcr.reject(v, w, "LS_MODE_DL", True)
        k = r.flags
        out.append((r.mu, w.sum() / len(w), 6 * np.sqrt((square[k] * n[k]).sum() / max(n[k].sum(), 1))))
    return out


@pytest.mark.parametrize("extra", [(), ((1.0, 0.5), (2.2, 1.1))])
def test_models_equal_plain_loops(spark, extra):
    rng = np.random.default_rng(4)
    n = 500
    p = pd.DataFrame({"survey_id": 0, "scan_id": rng.integers(0, 9, n), "sample_id": np.arange(n), "ra": rng.random(n) * 4, "dec": rng.random(n) * 3})
    p = p.assign(flux=rng.standard_normal(n) * 3 + rng.exponential(20, n) * (rng.random(n) < 0.3), dumps=rng.integers(1, 6, n).astype(float), scatter2d=2.0 + p.scan_id * 0.2)
    samples = spark.createDataFrame(p).selectExpr("int(survey_id) survey_id", "int(scan_id) scan_id", "int(sample_id) sample_id", "ra", "dec", "flux", "dumps", "scatter2d")
    places = spark.createDataFrame(extra, "mx double, my double") if extra else None
    found = neighbourhood.interference_models(samples, 0.35, extra=places)
    rows = {r.sample_id: r for r in found.collect()}
    want = plain_models(p, 0.35, extra)
    assert set(rows) == {i for i, v in enumerate(want) if v}
    for i, r in rows.items():
        assert (r.model, r.gm_weight, r.correlation) == pytest.approx(want[i], rel=1e-6, abs=1e-6)


def test_values_of_models_are_not_shuffled(spark):
    samples = spark.range(300).selectExpr("0 as survey_id", "int(id % 7) as scan_id", "int(id) as sample_id", "id % 17 * 0.1 as ra", "id % 19 * 0.1 as dec", "double(id % 5) as flux", "1.0d as dumps", "1.0d as scatter2d")
    samples = samples.selectExpr("survey_id", "scan_id", "sample_id", "double(ra) ra", "double(dec) dec", "flux", "dumps", "scatter2d")
    plan = neighbourhood.interference_models(samples, 0.35)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
