"""Smooth surfaces around every sample, for emission wider than the beam.

Around a sample a weighted polynomial of 10, 6 or 3 terms, as many as the samples there carry, is fitted; while the noise about it is above
the scatter that the scans have there, the sample with the largest weighted squared deviation goes and the rest is fitted again, so the
order falls as samples go. Neighbourhoods are met in the cells of starloom.operators.neighbourhood, each inside one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.neighbourhood import _Near, by_cell
from starloom.operators.surface import TERMS


def search_radius(beam: float, length: float, along: str = "ang_dist") -> Column:
    """Radius around each sample, for a background of `length` beams: a third of it, but no more than two thirds of the way to the scan's
    farther end, and a beam at least. `along` is the path along the scan."""
    w = Window.partitionBy("survey_id", "scan_id")
    end = F.greatest(F.max(along).over(w) - F.col(along), F.col(along) - F.min(along).over(w))
    return F.greatest(F.least(F.lit(length * beam / 3), 2 * end / 3), F.lit(float(beam)))


def most_terms(scans: np.ndarray) -> int:
    """Terms that samples of these scans carry: 10, 6 or 3 for 5, 4 or 2 scans, as many samples in one of them, and as many samples as terms; else 0."""
    _, n = np.unique(scans, return_counts=True)
    return next((k for k, s in ((10, 5), (6, 4), (3, 2)) if len(n) >= s and n.max() >= s and len(scans) >= k), 0)


def fitted(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, w: np.ndarray, terms: int) -> np.ndarray | None:
    """Coefficients of the weighted polynomial, constant first; None where it is not determined."""
    a = np.stack([dx**i * dy**j for i, j in TERMS[:terms]], axis=1) * np.sqrt(w)[:, None]
    scale = np.sqrt((a * a).sum(0))
    if not (scale > 0).all():
        return None
    c, _, rank, _ = np.linalg.lstsq(a / scale, z * np.sqrt(w), rcond=1e-10)
    return c / scale if rank == terms else None


def value(c: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return sum(k * dx**i * dy**j for k, (i, j) in zip(c, TERMS))


def curvature(c: np.ndarray, angle: float) -> float:
    """Second derivative of the surface at its middle along a direction (from x towards y)."""
    if len(c) < 6:
        return 0.0
    u, v = np.cos(angle), np.sin(angle)
    return float(sum(k * {(2, 0): 2 * u * u, (1, 1): 2 * u * v, (0, 2): 2 * v * v}.get(t, 0.0) for k, t in zip(c, TERMS)))


def surviving(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, w: np.ndarray, scans: np.ndarray, scatter: float, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Which samples stay, and the coefficients of the last fit; `rounds` ends the rejection early."""
    kept = np.ones(len(z), dtype=bool)
    while True:
        c, terms = None, most_terms(scans[kept])
        while c is None and terms:
            c = fitted(dx[kept], dy[kept], z[kept], w[kept], terms)
            terms = {10: 6, 6: 3, 3: 0}[terms] if c is None else terms
        if c is None or rounds == 0:
            return kept, c
        far = w[kept] * (z[kept] - value(c, dx[kept], dy[kept])) ** 2
        free = w[kept].sum() - terms * (w[kept] ** 2).sum() / w[kept].sum()
        if free <= 0 or np.sqrt(far.sum() / free) <= scatter:
            return kept, c
        kept[np.flatnonzero(kept)[int(far.argmax())]] = False
        rounds = None if rounds is None else rounds - 1


def local_surfaces(samples: DataFrame, most: float, radius: str = "radius", weight_scale: float = 2 / 3, flux: str = "flux", gap: str = "theta_gap", scatter: str = "scatter2d", weight: str = "dumps", x: str = "ra", y: str = "dec", rounds: int | None = None) -> DataFrame:
    """survey_id, scan_id, sample_id and the surface at each sample: surface (its value), coefficients, terms, curvature (second derivative across the
    scan), n and n_kept.

    `radius` is a column, no more than `most` anywhere; kernel weights fall to a half at weight_scale radii, or four thirds of the sample's gap, if
    that is more; so narrow a kernel that fewer samples than terms have weight ends the rejection. A sample around which no surface is determined keeps its flux, with no coefficients. Samples without a place have no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["survey_id", "scan_id", "sample_id"])
        px, py, z, dumps, noise, reach, hole = (pdf[c].to_numpy(float) for c in (x, y, flux, weight, scatter, radius, gap))
        track = pdf["track__"].to_numpy(float)
        near = _Near(px, py, most)
        scans = pd.factorize(pd.MultiIndex.from_frame(pdf[["survey_id", "scan_id"]]))[0]
        own = np.flatnonzero(pdf["own"].to_numpy(bool))
        rows = []
        for i in own:
            at, d = near.of(px[i], py[i], reach[i])
            half = max(weight_scale * reach[i], min(4 / 3 * hole[i], reach[i]))
            power = -np.log(2) / np.log(np.cos(np.pi * half / (4 * reach[i])))
            w = dumps[at] * np.cos(np.pi * d / (2 * reach[i])) ** power
            kept, c = surviving(px[at] - px[i], py[at] - py[i], z[at], w, scans[at], float(noise[at].mean()), rounds)
            found = c is not None
            rows.append((float(c[0]) if found else z[i], c.tolist() if found else [], len(c) if found else 0, curvature(c, track[i] + np.pi / 2) if found else 0.0, len(at), int(kept.sum())))
        out = pdf.iloc[own][["survey_id", "scan_id", "sample_id"]].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(rows, columns=["surface", "coefficients", "terms", "curvature", "n", "n_kept"])], axis=1)

    w = Window.partitionBy("survey_id", "scan_id").orderBy("sample_id")
    step = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    turned = samples.withColumn("track__", F.atan2(step(y), step(x)))
    schema = "survey_id int, scan_id int, sample_id int, surface double, coefficients array<double>, terms int, curvature double, n int, n_kept int"
    return by_cell(turned, most, x, y, [flux, weight, scatter, radius, gap, "track__"], run, schema)
