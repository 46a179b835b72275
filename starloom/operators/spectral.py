"""Operators on spectra held as arrays of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_range(data: Column, start: int, stop: int) -> Column:
    """Channels start to stop, counted from 1 and both included, in reverse order."""
    return F.reverse(F.slice(data, start, stop - start + 1))


def channel_trim(data: Column, start: int, stop: int) -> Column:
    """Channels start up to stop, counted from 0, stop excluded."""
    return F.slice(data, start + 1, stop - start)


def frequency_axis(n: Column, step: float, centre_ghz: float, centre_offset: float) -> Column:
    """Frequency in Hz of each of n channels."""
    first = centre_ghz * 1e6 - centre_offset * step + step
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.lit(first) + j * step)


def band_integral(data: Column, frequencies: Column, bands: tuple[float, float] | list[tuple[float, float]], notches: list[tuple[float, float]] = ()) -> Column:
    """Sum of the channels strictly inside the band, or any of several, and outside every notch, whose edges belong to it."""
    several = [bands] if bands and not isinstance(bands[0], (tuple, list)) else list(bands)

    def inside(f: Column) -> Column:
        keep = F.lit(False)
        for a, b in several:
            keep = keep | ((f > a) & (f < b))
        for a, b in notches:
            keep = keep & ~((f >= a) & (f <= b))
        return keep

    return F.aggregate(F.zip_with(data, frequencies, lambda y, f: F.when(inside(f), y).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def continuum(data: Column) -> Column:
    """Sum over all channels."""
    return F.aggregate(data, F.lit(0.0), lambda a, x: a + x)


def channel_sums(spectra: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Sum over rows of every channel: keys, channel, total."""
    return spectra.select(*keys, F.posexplode(data).alias("channel", "value")).groupBy(*keys, "channel").agg(F.sum("value").alias("total"))


def mask_nan(data: Column) -> Column:
    """NaN channels as NULL."""
    return F.transform(data, lambda x: F.when(~F.isnan(x), x))


def in_frequency_ranges(data: Column, frequencies: Column, include: list[tuple[float, float]], exclude: list[tuple[float, float]]) -> Column:
    """Channels inside any included range (all, if there is none) and outside every excluded one; strict limits."""

    def keep(f: Column) -> Column:
        ok = F.lit(not include)
        for a, b in include:
            ok = ok | ((f > a) & (f < b))
        for a, b in exclude:
            ok = ok & ~((f > a) & (f < b))
        return ok

    pairs = F.filter(F.zip_with(data, frequencies, lambda y, f: F.struct(y.alias("y"), f.alias("f"))), lambda p: keep(p["f"]))
    return F.transform(pairs, lambda p: p["y"])


def excise_dropouts(data: Column, parallel: dict[str, Column]) -> Column:
    """Array of structs (flux and the parallel arrays) without the channels of negative flux; index keeps the place."""
    zipped = F.arrays_zip(data.alias("flux"), *[c.alias(k) for k, c in parallel.items()], F.sequence(F.lit(0), F.size(data) - 1).alias("index"))
    return F.filter(zipped, lambda x: x["flux"] >= 0)


def refill_dropouts(spectra: DataFrame, key: str, kept: str, n: str, out: str) -> DataFrame:
    """Rows (key, channel, out) for all n channels, excised ones filled linearly by channel."""
    from starloom.operators.ordered import fill_gaps

    all_ = spectra.select(key, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("channel"))
    have = spectra.select(key, F.explode(kept).alias("c")).select(key, F.col("c.index").alias("channel"), F.col("c.flux").alias("value"))
    return fill_gaps(all_.join(have, [key, "channel"], "left"), [key], "channel", "value", out).drop("value")


def baseline_zones(frequencies: Column, rest: float, zones: list[tuple[float, float, float]], default: float) -> Column:
    """Baseline scale of each channel: the value of the zone (low and high velocity in km/s, value) it lies in."""

    def scale(f: Column) -> Column:
        v = (F.lit(rest) - f) / rest * 299792.458
        c = F.lit(default)
        for low, high, value in zones:
            c = F.when((v >= low) & (v <= high), value).otherwise(c)
        return c

    return F.transform(frequencies, scale)


def deinterleave(spectra: DataFrame, order: str, value: str, roles: list[str], keep: list[str]) -> DataFrame:
    """Groups of len(roles) consecutive rows as one row; a role names its row's value, and the columns of `keep`
    come from the group's first row. Rows are numbered by `order` from 0 without gaps, so no global sort is needed."""
    n = len(roles)
    place = F.pmod(F.col(order), F.lit(n))
    sums = [F.max(F.when(place == i, F.col(value))).alias(role) for i, role in enumerate(roles) if role]
    return spectra.groupBy(F.floor(F.col(order) / n).alias("pair_id")).agg(*[F.min_by(k, order).alias(k) for k in keep], *sums)
