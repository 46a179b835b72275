"""Removal of slowly varying backgrounds along scans (and along spectra).

Windows of many scans are fitted in step, as rows of padded arrays of like length: a step is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.grouped import extended
from starloom.operators.rcr_groups import ELEMENTS, _pick, _sum, reject_many


def _free(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values of each row's weighted quadratic from its normal equations; a straight mean where they are singular. What has no weight is not fitted."""
    x2 = x * x
    wx, wx2 = w * x, w * x2
    s = [_sum(c) for c in (w, wx, wx2, wx * x2, wx2 * x2)]
    a = np.stack([np.stack(s[i : i + 3], axis=-1) for i in range(3)], axis=-2)
    b = np.stack([_sum(c) for c in (w * y, wx * y, wx2 * y)], axis=-1)
    scale = 1 / np.sqrt(np.maximum(np.stack(s[::2], axis=-1), 1e-300))
    a, b = a * scale[:, :, None] * scale[:, None, :], b * scale
    try:
        c = np.linalg.solve(a, b[:, :, None])[:, :, 0] * scale
    except np.linalg.LinAlgError:
        c = np.zeros_like(b)
        for i in range(len(a)):
            try:
                c[i] = np.linalg.solve(a[i], b[i]) * scale[i]
            except np.linalg.LinAlgError:
                c[i, 0] = (w[i] * y[i]).sum() / w[i].sum()
    return c[:, :1] + x * (c[:, 1:2] + x * c[:, 2:])


def _anchored(x: np.ndarray, y: np.ndarray, w: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """Values of each row's weighted quadratic through (0, y0)."""
    v, x2 = y - y0[:, None], x * x
    wx, wx2 = w * x, w * x2
    a, b, c, e, f = (_sum(z) for z in (wx2, wx2 * x, wx2 * x2, wx * v, wx2 * v))
    det = a * c - b * b
    whole = det > 1e-14 * a * c
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(whole, (e * c - f * b) / det, np.where(a > 0, e / a, 0.0))
        q = np.where(whole, (a * f - b * e) / det, 0.0)
    return y0[:, None] + x * (p[:, None] + x * q[:, None])


def _mean_square_above(r: np.ndarray, kept: np.ndarray) -> np.ndarray:
    above = kept & (r > 0)
    return _sum(np.where(above, r * r, 0.0)) / np.maximum(above.sum(axis=1), 1)


def _ends(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return kept.argmax(axis=1), kept.shape[1] - 1 - kept[:, ::-1].argmax(axis=1)


def window_models(x: np.ndarray, y: np.ndarray, w: np.ndarray, m: np.ndarray, scatter: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baselines of windows, whose m samples are a row: (kept, values). Positive outliers go one by one from a quadratic through the anchor
    until the root mean square of what lies above is at most the scatter. Then the anchor goes, and the lowest
    rejected point from one before the survivors' span to one beyond it comes back, again and again, while the root mean
    square above a free quadratic is below the scatter. The last one goes again if the root mean square was closer to
    the scatter without it. Nothing is kept where fewer than four points are left."""
    inside = np.arange(x.shape[1]) < m[:, None]
    x = np.where(inside, x - _pick(x, anchor)[:, None], 0.0)
    kept = inside.copy()
    values = np.zeros_like(x)
    y0 = _pick(y, anchor)
    act = np.arange(len(x))
    while len(act):
        k = kept[act]
        enough = k.sum(axis=1) >= 4
        act, k = act[enough], k[enough]
        if not len(act):
            break
        r = y[act] - _anchored(x[act], y[act], np.where(k, w[act], 0.0), y0[act])
        high = _mean_square_above(r, k) > scatter[act] ** 2
        act, r = act[high], np.where(k, r, -np.inf)[high]
        r[np.arange(len(act)), anchor[act]] = -np.inf
        kept[act, r.argmax(axis=1) if len(act) else act] = False
    kept[np.arange(len(x)), anchor] = False
    kept[kept.sum(axis=1) < 4] = False
    act = np.flatnonzero(kept.any(axis=1))
    last, gap = np.full(len(x), -1), np.full(len(x), np.inf)
    col = np.arange(x.shape[1])
    while len(act):
        k = kept[act]
        r = y[act] - _free(x[act], y[act], np.where(k, w[act], 0.0))
        spread = np.sqrt(_mean_square_above(r, k))
        first, end = _ends(k)
        out = ~k & inside[act] & (col >= first[:, None] - 1) & (col <= end[:, None] + 1)
        off = np.abs(scatter[act] - spread)
        over = (spread >= scatter[act]) | ~out.any(axis=1)
        back = act[over & (last[act] >= 0) & (gap[act] < off)]
        kept[back, last[back]] = False
        act = act[~over]
        gap[act] = off[~over]
        if len(act):
            last[act] = np.where(out, r, np.inf)[~over].argmin(axis=1)
            kept[act, last[act]] = True
    act = np.flatnonzero(kept.any(axis=1))
    if len(act):
        values[act] = _free(x[act], y[act], np.where(kept[act], w[act], 0.0))
    return kept, values


def window_model(x: np.ndarray, y: np.ndarray, w: np.ndarray, scatter: float, anchor: int) -> tuple[np.ndarray, np.ndarray] | None:
    """window_models of one window: (kept, values); None where nothing is kept."""
    kept, values = window_models(x[None], y[None], w[None], np.array([len(x)]), np.array([float(scatter)]), np.array([anchor]))
    return (kept[0], values[0]) if kept.any() else None


def _local_values(x: np.ndarray, y: np.ndarray, w: np.ndarray, begin: np.ndarray, m: np.ndarray, anchor: np.ndarray, scatter: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window, sample, value (a multiple of the unit) and weight of what windows of like length give to the samples of their spans."""
    col = np.arange(int(m.max()))
    at = np.minimum(begin[:, None] + col, len(x) - 1)
    inside = col < m[:, None]
    px, py, pw = x[at], np.where(inside, y[at], 0.0), np.where(inside, w[at], 0.0)
    kept, local = window_models(px, py, pw, m, scatter, anchor)
    rows = np.flatnonzero(kept.any(axis=1))
    kept, local, px, py = kept[rows], local[rows], px[rows], py[rows]
    first, end = _ends(kept)
    given = (col >= first[:, None]) & (col <= end[:, None]) & (kept | (local <= py))
    pw = np.where(kept, pw[rows], 0.0)
    total = _sum(pw)
    d = px - (_sum(np.where(kept, px * pw, 0.0)) / total)[:, None]
    s = np.maximum(np.sqrt(_sum(np.where(kept, d**2 * pw, 0.0)) / total), 1e-12)
    k = np.maximum((_sum(np.where(kept, d**4 * pw, 0.0)) / total) ** 0.25, 1e-12)
    weight = total[:, None] / (1 + (d / s[:, None]) ** 2 + (d / k[:, None]) ** 4)
    row, _ = np.nonzero(given)
    return rows[row], at[rows][given], (np.round(local / unit[rows, None]) * unit[rows, None])[given], weight[given]


def backgrounds(x: np.ndarray, y: np.ndarray, w: np.ndarray, scatter: np.ndarray, length: float, starts: np.ndarray) -> np.ndarray:
    """Background at every sample of scans with positions x (ascending in each); `starts` is where each begins (one more entry than scans),
    and the scatter is each scan's.

    Windows of the given length start at every sample, forward and backward. Every window adds a local value to the
    samples of its span, but for rejected ones below it, weighted by its summed weights and by closeness to its
    centre; the values of a sample are combined by the robust mean, and samples without any are filled linearly.
    Windows that keep the same samples have the same baseline but for rounding, to which a mode is open, so values count in units of
    2^-30 of the scan's largest sample.
    """
    out = np.zeros(len(x))
    sizes = np.diff(starts)
    if length <= 0 or not len(x) or sizes.max() < 4:
        return out
    place = np.arange(len(x))
    ends, begins = place.copy(), place + 1
    for a, b in zip(starts[:-1][sizes >= 4].tolist(), starts[1:][sizes >= 4].tolist()):
        p = x[a:b]
        ends[a:b] = a + np.searchsorted(p, p + length, side="right")
        begins[a:b] = a + np.searchsorted(p, p - length, side="left")
    ahead, behind = np.flatnonzero(ends - place >= 4), np.flatnonzero(place + 1 - begins >= 4)
    begin, end, own = (np.concatenate(c) for c in ((ahead, begins[behind]), (ends[ahead], behind + 1), (ahead, behind)))
    order = np.lexsort((own, end, begin))
    begin, m, own = begin[order], (end - begin)[order], own[order]
    scan = np.repeat(np.arange(len(sizes)), sizes)
    most = np.zeros(len(sizes))
    np.fmax.at(most, scan, np.where(np.isfinite(y), np.abs(y), 0.0))
    unit = np.exp2(np.ceil(np.log2(np.maximum(most, 1e-200))) - 30)
    by_size = np.argsort(m, kind="stable")
    found, i = [], 0
    while i < len(by_size):
        wide = m[by_size[i : i + ELEMENTS]] * np.arange(1, min(ELEMENTS, len(by_size) - i) + 1)
        rows = by_size[i : i + max(1, int(np.searchsorted(wide, ELEMENTS, side="right")))]
        i += len(rows)
        window, *rest = _local_values(x, y, w, begin[rows], m[rows], own[rows] - begin[rows], scatter[of := scan[own[rows]]], unit[of])
        found.append((rows[window], *rest))
    window, sample, value, weight = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 4
    order = np.lexsort((window, sample))
    each = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(np.bincount(sample, minlength=len(x)), out=each[1:])
    mean = reject_many(value[order], weight[order], each, "LS_MODE_DL").mu
    for a, b in zip(starts[:-1][sizes >= 4].tolist(), starts[1:][sizes >= 4].tolist()):
        known = np.flatnonzero(np.isfinite(mean[a:b]))
        out[a:b] = np.interp(np.arange(b - a), known, mean[a:b][known]) if len(known) else 0.0
    return out


def scan_background(x: np.ndarray, y: np.ndarray, w: np.ndarray, scatter: float, length: float) -> np.ndarray:
    """Background at every sample of one scan."""
    return backgrounds(*(np.asarray(c, dtype=float) for c in (x, y, w)), np.array([float(scatter)]), length, np.array([0, len(x)]))


def background(samples: DataFrame, length: float, scatter: str = "scatter", x: str = "ang_dist", y: str = "flux", weight: str = "dumps", keys: list[str] = ("survey_id", "scan_id"), out: str = "background") -> DataFrame:
    """samples with the column `out`. One scan (a bounded run of the telescope) is one group; `length` and x share a unit.

    Keys (survey, spectrum) and x = frequency give spectral cleaning; x = elevation gives the elevation background.
    A length of 0 skips the stage: the background is 0.
    """

    def run(place: np.ndarray, value: np.ndarray, w: np.ndarray, noise: np.ndarray, starts: np.ndarray) -> tuple:
        return (backgrounds(place, value, w, noise[starts[:-1]], length, starts),)

    order = [F.col(x).asc_nulls_last(), *["sample_id"] * ("sample_id" in samples.columns)]
    return extended(samples, list(keys), [x, y, weight, scatter], f"`{out}` double", run, order)
