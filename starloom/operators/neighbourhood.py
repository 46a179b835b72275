"""Operators on the samples around each sample: interference models and sampling gaps.

Samples are dealt to square cells of a few search radii; a cell also gets the samples of a margin of one radius
around it, so every neighbourhood lies inside one task and each sample is sent to few cells. Cells, not
neighbourhoods, are groups: there are few of them and their size follows the beam, not the survey.

Where surveys pile up, cells are the leaves of a quadtree: a cell with more than CROWD samples of its own is cut into four, down to half a
radius a side. A smaller cell would hold hardly less, as its margin alone has a neighbourhood's samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.grouped import SURVEYS
from starloom.operators.rcr_groups import ELEMENTS, _sum, reject_many
from starloom.operators.spatial import in_boxes
from starloom.sources.tables import written

CELL_RADII = 4.0
#: Own samples of a cell from which on it is cut, and how often a cell may be cut.
CROWD, DEPTH = 20_000, 3
#: Pairs of a place and a sample near it that are looked at at once.
PAIRS = 1_000_000


def leaves(samples: DataFrame, radius: float, x: str, y: str, crowd: int | None = None) -> DataFrame:
    """The quadtree's leaves that hold samples: leaf, lx, ly (low corner), side, and n, the samples inside.

    Samples are counted once in the smallest cells, whose number follows the area; all levels are sums of these counts.
    """
    size, crowd = CELL_RADII * radius, crowd or CROWD
    fine = size / 2**DEPTH
    cell = lambda c: F.floor(F.col(c) / fine).alias(f"f{c}")
    counts = written(samples.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(x), cell(y)).agg(F.count("*").alias("n")), "cells")
    found, open_ = None, None
    for level in range(DEPTH + 1):
        wide = 2 ** (DEPTH - level)
        up = lambda c, by=wide: F.floor(F.col(c) / by)
        cells = counts.select(up(f"f{x}").alias("cx"), up(f"f{y}").alias("cy"), "n").groupBy("cx", "cy").agg(F.sum("n").alias("n"))
        if open_ is not None:
            # only quarters of cells that were cut
            cells = cells.join(open_, (F.floor(F.col("cx") / 2) == F.col("ox")) & (F.floor(F.col("cy") / 2) == F.col("oy")), "left_semi")
        here = cells if level == DEPTH else cells.filter(F.col("n") <= crowd)
        side = fine * wide
        made = here.select(F.format_string("%d:%d:%d", F.lit(level), "cx", "cy").alias("leaf"), (F.col("cx") * side).alias("lx"), (F.col("cy") * side).alias("ly"), F.lit(side).alias("side"), "n")
        found = made if found is None else found.unionByName(made)
        open_ = cells.filter(F.col("n") > crowd).select(F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    return written(found, "leaves")


def by_cell(samples: DataFrame, radius: float, x: str, y: str, columns: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, crowd: int | None = None) -> DataFrame:
    """Applies run to each leaf of the quadtree; its frame has `own` (whether the sample belongs to the leaf, not to its margin)."""
    size = CELL_RADII * radius
    names = list(dict.fromkeys(["survey_id", "scan_id", "sample_id", x, y, *columns]))
    cells = leaves(samples, radius, x, y, crowd)
    boxes = cells.select("leaf", "lx", "ly", "side", *((F.col(c) + d).alias(n) for c, d, n in (("lx", -radius, "x_from"), ("lx", F.col("side") + radius, "x_to"), ("ly", -radius, "y_from"), ("ly", F.col("side") + radius, "y_to"))))
    boxes = F.broadcast(boxes) if cells.count() <= SURVEYS else boxes
    spread = in_boxes(samples.select(*names), boxes, x, y, ("x_from", "x_to", "y_from", "y_to"), size)
    # the smallest cell that holds a sample, so rounding at a side cannot give it to two
    fine = size / 2**DEPTH
    inside = lambda c, low: (F.floor(F.col(c) / fine) >= F.round(F.col(low) / fine)) & (F.floor(F.col(c) / fine) < F.round((F.col(low) + F.col("side")) / fine))
    return spread.withColumn("own", inside(x, "lx") & inside(y, "ly")).select("leaf", *names, "own").groupBy("leaf").applyInPandas(run, schema)


class _Near:
    """Neighbours of points within a radius, by a sort along x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        self.x, self.y, self.radius = x, y, radius
        self.order = np.argsort(x, kind="stable")
        self.sorted = x[self.order]

    def of(self, x: float, y: float, radius: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        r = radius or self.radius
        a, b = np.searchsorted(self.sorted, [x - r, x + r])
        at = self.order[a:b]
        d = np.hypot(self.x[at] - x, self.y[at] - y)
        hit = d < r
        return at[hit], d[hit]


def local_fit(d: np.ndarray, z: np.ndarray, w: np.ndarray, radius: float) -> tuple[float, float, np.ndarray]:
    """f, g and p of the weighted fit z = f p + g with p = cos^2(pi d / 2 radius); a zero prior doubles the weight on g."""
    p = np.cos(np.pi * d / (2 * radius)) ** 2
    s, fz, zs, ps, q = w.sum(), (w * z * p).sum(), (w * z).sum(), (w * p).sum(), (w * p * p).sum()
    det = 2 * s * q - ps * ps
    if not det > 0:
        return 0.0, 0.0, p
    f = (2 * s * fz - zs * ps) / det
    return f, (zs - f * ps) / (2 * s), p


def local_fits(near: DataFrame, keys: list[str], z: str, w: str, radius: float, distance: str = "distance") -> DataFrame:
    """keys, f and g of local_fit around each place, from sums that are partial before their shuffle; NULL where the
    kernel is next to nothing or the fit singular."""
    p = F.pow(F.cos(F.lit(np.pi) * F.col(distance) / (2 * radius)), F.lit(2.0))
    v, z, w = near.withColumn("p__", p), F.col(z), F.col(w)
    sums = v.groupBy(*keys).agg(F.sum(w).alias("s"), F.sum(w * z * F.col("p__")).alias("fz"), F.sum(w * z).alias("zs"), F.sum(w * F.col("p__")).alias("ps"), F.sum(w * F.col("p__") * F.col("p__")).alias("q"))
    det = F.expr("2 * s * q - ps * ps")
    f = F.when((F.col("q") > 1e-9 * F.col("s")) & (det > F.expr("2e-9 * s * q")), F.expr("2 * s * fz - zs * ps") / det)
    return sums.withColumn("f", f).select(*keys, "f", F.expr("(zs - f * ps) / (2 * s)").alias("g"))


def surviving_models(d: np.ndarray, z: np.ndarray, w: np.ndarray, m: np.ndarray, scatter: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Kept flags and model values of neighbourhoods, whose m samples are a row: the most positive outlier goes until the mean square above
    equals the scatter; both signs where f <= 0."""
    kept = np.arange(d.shape[1]) < m[:, None]
    values = np.zeros_like(d)
    p = np.cos(np.pi * d / (2 * radius)) ** 2
    act = np.flatnonzero(m > 0)
    while len(act):
        k, pa, za = kept[act], p[act], z[act]
        wa = np.where(k, w[act], 0.0)
        wz, wp = wa * za, wa * pa
        s, fz, zs, ps, q = (_sum(c) for c in (wa, wz * pa, wz, wp, wp * pa))
        det = 2 * s * q - ps * ps
        fit = det > 0
        f = np.where(fit, (2 * s * fz - zs * ps) / np.where(fit, det, 1.0), 0.0)
        g = np.where(fit, (zs - f * ps) / np.where(fit, 2 * s, 1.0), 0.0)
        made = f[:, None] * pa + g[:, None]
        values[act] = made
        r = za - made
        up = (f > 0)[:, None]
        side = k & ((r > 0) | ~up)
        beside = np.where(side, wa, 0.0)
        total = _sum(beside)
        go = (k.sum(axis=1) > 3) & side.any(axis=1)
        go &= ~(np.sqrt(_sum(beside * r * r) / np.where(total > 0, total, 1.0)) <= scatter[act])
        score = np.where(side, np.where(up, r, np.abs(r)), -np.inf)[go]
        act = act[go]
        if len(act):
            kept[act, score.argmax(axis=1)] = False
    return kept, values


def _in_reach(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, sample and distance of the samples within the radius of each place (mx, my), some places at a time; a place's samples by x."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    a, b = np.searchsorted(ordered, mx - radius), np.searchsorted(ordered, mx + radius)
    total = np.cumsum(b - a)
    i = 0
    while i < len(mx):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
        n = (b - a)[i:j]
        place = np.repeat(np.arange(i, j), n)
        at = order[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[i:j], n)]
        d = np.hypot(x[at] - mx[place], y[at] - my[place])
        hit = d < radius
        yield place[hit], at[hit], d[hit]
        i = j


def _model_values(place: np.ndarray, at: np.ndarray, d: np.ndarray, z: np.ndarray, dumps: np.ndarray, noise: np.ndarray, radius: float, own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Sample, value, weight, n and square of what the models of these places give to own samples that they keep."""
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    size = np.diff(np.append(begin, len(place)))
    by_size = np.argsort(size, kind="stable")
    i = 0
    while i < len(by_size):
        wide = size[by_size[i : i + ELEMENTS]] * np.arange(1, min(ELEMENTS, len(by_size) - i) + 1)
        rows = by_size[i : i + max(1, int(np.searchsorted(wide, ELEMENTS, side="right")))]
        i += len(rows)
        m = size[rows]
        col = np.arange(int(m.max()))
        inside = col < m[:, None]
        pair = np.minimum(begin[rows, None] + col, len(place) - 1)
        sample = at[pair]
        far, flux, w, n = (np.where(inside, c, 0.0) for c in (d[pair], z[sample], dumps[sample] / np.maximum(noise[sample], 1e-12) ** 2, noise[sample]))
        kept, value = surviving_models(far, flux, w, m, _sum(n) / m, radius)
        p = np.cos(np.pi * far / (2 * radius)) ** 2
        wk = np.where(kept, w, 0.0)
        total = _sum(wk)
        mean = (_sum(wk * p) / total)[:, None]
        var = np.maximum(_sum(wk * (p - mean) ** 2) / total, 1e-12)[:, None]
        local = _sum(np.where(kept, dumps[sample], 0.0))[:, None] / (1 + 2 * (p - mean) ** 2 / var)
        square = np.broadcast_to((_sum(wk * far**2) / total)[:, None], kept.shape)
        n = np.broadcast_to(kept.sum(axis=1)[:, None], kept.shape)
        give = kept & own[sample]
        yield sample[give], value[give], local[give], n[give], square[give]


def interference_models(samples: DataFrame, radius: float, x: str = "ra", y: str = "dec", flux: str = "flux", scatter: str = "scatter2d", weight: str = "dumps", extra: DataFrame | None = None) -> DataFrame:
    """survey_id, scan_id, sample_id, model, gm_weight, correlation of every sample that some local model keeps.

    A local model is fitted around every sample; each sample it keeps gets its value and a weight; a sample's
    values, in units of 2^-30 of the largest, are combined by the robust mean. Samples that no model keeps have no row. Radius 0 is no stage. `extra` has more
    places (mx, my) around which models are fitted.
    """
    columns = [flux, scatter, weight]
    if extra is not None:
        # places travel as samples without a scan
        more = extra.select(F.col("mx").alias(x), F.col("my").alias(y))
        samples = samples.select("survey_id", "scan_id", "sample_id", x, y, *columns).unionByName(more, allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = ["survey_id", "scan_id", "sample_id"]
        mx, my = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        pdf = pdf[~pdf["scan_id"].isna().to_numpy()].sort_values(keys, kind="stable")
        px, py, z, dumps, noise = (pdf[c].to_numpy(float) for c in (x, y, flux, weight, scatter))
        own = pdf["own"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=[*keys, "model", "gm_weight", "correlation"])
        # a model near an own sample is within a radius of them, and its samples within two
        near = (mx >= px[own].min() - radius) & (mx <= px[own].max() + radius) & (my >= py[own].min() - radius) & (my <= py[own].max() + radius)
        at = np.flatnonzero(near)[np.lexsort((my[near], mx[near]))]
        given = [v for pairs in _in_reach(px, py, mx[at], my[at], radius) if len(pairs[0]) for v in _model_values(*pairs, z, dumps, noise, radius, own)]
        sample, value, w, n, square = (np.concatenate(c) for c in zip(*given)) if given else (np.zeros(0, dtype=np.int64),) * 5
        # models around the same place are the same but for rounding, to which a mode is open
        most = np.zeros(len(px))
        np.maximum.at(most, sample, np.abs(value))
        unit = np.exp2(np.ceil(np.log2(np.maximum(most, 1e-200))) - 30)[sample]
        value = np.round(value / unit) * unit
        order = np.lexsort((square, n, w, value, sample))
        sample, value, w, n, square = (c[order] for c in (sample, value, w, n, square))
        starts = np.append(np.flatnonzero(np.diff(sample, prepend=-1)), len(sample))
        if len(starts) < 2:
            return pd.DataFrame(columns=[*keys, "model", "gm_weight", "correlation"])
        r = reject_many(value, w, starts, "LS_MODE_DL", True)
        total = lambda c: np.add.reduceat(c, starts[:-1])
        out = pdf.iloc[sample[starts[:-1]]][keys].reset_index(drop=True)
        correlation = 6 * np.sqrt(total(np.where(r.flags, square * n, 0.0)) / np.maximum(total(np.where(r.flags, n, 0)), 1))
        return out.assign(model=r.mu, gm_weight=total(w) / np.diff(starts), correlation=correlation)

    # with a margin of two radii a cell has all models of its own samples, so none of their values is shuffled
    return by_cell(samples, 2 * radius, x, y, columns, run, "survey_id int, scan_id int, sample_id int, model double, gm_weight double, correlation double")


def sampling_gap(samples: DataFrame, radius: float, least: float | str = 0.0, cap: float = 0.75, x: str = "ra", y: str = "dec", out: str = "theta_gap") -> DataFrame:
    """survey_id, scan_id, sample_id and the widest gap in radians around each sample: over eight directions, the
    diameter of the largest empty circle that touches the sample; neighbours closer than `least` (a number, or a column of the samples) do not count,
    and the gap is at most `cap` radii."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        near = _Near(px, py, radius)
        own = np.flatnonzero(pdf["own"].to_numpy(bool))
        gaps = []
        limit = pdf[least].to_numpy(float) if isinstance(least, str) else np.full(len(px), least)
        axes = np.arange(8) * (np.pi / 4)
        c, t = np.cos(axes)[:, None], np.sin(axes)[:, None]
        for i in own:
            at, d = near.of(px[i], py[i])
            at = at[d > limit[i]]
            dx, dy = px[at] - px[i], py[at] - py[i]
            # all eight sectors at once: along and across each axis
            u, v = c * dx + t * dy, c * dy - t * dx
            inside = (u >= np.abs(v) - 1e-12) & (u > 1e-12)
            touch = np.where(inside, (dx * dx + dy * dy) / np.where(inside, u, 1.0), radius)
            widest = float(np.minimum(touch.min(axis=1), radius).max()) if len(at) else radius
            gaps.append(np.radians(min(widest, cap * radius)))
        return pdf.iloc[own][["survey_id", "scan_id", "sample_id"]].reset_index(drop=True).assign(**{out: gaps})

    return by_cell(samples, radius, x, y, [least] if isinstance(least, str) else [], run, f"survey_id int, scan_id int, sample_id int, {out} double")


def forced_gap(samples: DataFrame, gap: float, out: str = "theta_gap") -> DataFrame:
    return samples.withColumn(out, F.lit(float(gap)))


def extra_models(sources: DataFrame, beam: float, rfi: float, gap: float) -> DataFrame:
    """Places of the additional models around bright sources: a grid of an even number of half steps a side, where
    root(gap / beam) < rfi < 1; otherwise none."""
    if not (gap / beam) ** 0.5 < rfi < 1:
        return sources.limit(0).select("*", F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    half = int(np.floor(beam / gap * rfi**2))
    half += half % 2
    step, reach = gap * (1 / rfi**2 - 1), 2 * beam * (1 - rfi**2)
    axis = F.sequence(F.lit(-half), F.lit(half))
    grid = sources.select("*", F.explode(axis).alias("i__")).select("*", F.explode(axis).alias("j__"))
    grid = grid.withColumns({"mx": F.col("ra") + F.col("i__") * step, "my": F.col("dec") + F.col("j__") * step})
    return grid.filter(F.sqrt((F.col("mx") - F.col("ra")) ** 2 + (F.col("my") - F.col("dec")) ** 2) <= reach).drop("i__", "j__")
