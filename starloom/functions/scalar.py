"""Scalar Column functions of the mapping engine. Angles are degrees unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction of the north galactic pole and origin of galactic longitude (J2000, degrees).
POLE_RA, POLE_DEC, ORIGIN_L = 192.8595, 27.1284, 122.9320
LIGHT = 299792458.0
#: Dish diameters in metres by telescope.
DISHES = {"20m": 20.0, "gbt": 105.0, "40ft": 12.192}


def galactic_b(ra: Column, dec: Column) -> Column:
    """Galactic latitude of an equatorial position."""
    pole = F.radians(F.lit(POLE_DEC))
    return F.degrees(arc_sin(F.sin(pole) * F.sin(F.radians(dec)) + F.cos(pole) * F.cos(F.radians(dec)) * F.cos(F.radians(ra - POLE_RA))))


def galactic_l(ra: Column, dec: Column) -> Column:
    """Galactic longitude of an equatorial position, in [0, 360)."""
    pole, d, a = F.radians(F.lit(POLE_DEC)), F.radians(dec), F.radians(ra - POLE_RA)
    turn = F.degrees(F.atan2(F.cos(d) * F.sin(a), F.cos(pole) * F.sin(d) - F.sin(pole) * F.cos(d) * F.cos(a)))
    return F.pmod(F.lit(ORIGIN_L) - turn, F.lit(360.0))


def equatorial_dec(lon: Column, lat: Column) -> Column:
    """Declination of a galactic position; from both sides of its angle, so that it is as exact next to the poles."""
    pole, b, t = F.radians(F.lit(POLE_DEC)), F.radians(lat), F.radians(F.lit(ORIGIN_L) - lon)
    up = F.sin(pole) * F.sin(b) + F.cos(pole) * F.cos(b) * F.cos(t)
    return F.degrees(F.atan2(up, F.hypot(F.cos(b) * F.sin(t), F.cos(pole) * F.sin(b) - F.sin(pole) * F.cos(b) * F.cos(t))))


def equatorial_ra(lon: Column, lat: Column) -> Column:
    """Right ascension of a galactic position, not wrapped."""
    pole, b, t = F.radians(F.lit(POLE_DEC)), F.radians(lat), F.radians(F.lit(ORIGIN_L) - lon)
    return F.lit(POLE_RA) + F.degrees(F.atan2(F.cos(b) * F.sin(t), F.cos(pole) * F.sin(b) - F.sin(pole) * F.cos(b) * F.cos(t)))


def arc_sin(x: Column) -> Column:
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def arc_cos(x: Column) -> Column:
    """acos with its argument clamped to [-1, 1]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def sphere_distance(dec1: Column, ra1: Column, dec2: Column, ra2: Column) -> Column:
    """Great-circle distance in radians between plain coordinates; NaN counts as 0."""
    a, b = F.radians(dec1), F.radians(dec2)
    return F.nanvl(arc_cos(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(ra1 - ra2))), F.lit(0.0))


def centred_distance(dec1: Column, ra1: Column, dec2: Column, ra2: Column, centre_dec: float) -> Column:
    """Great-circle distance in radians between coordinates centred on centre_dec, right ascension scaled by its cosine."""
    scale = F.cos(F.radians(F.lit(float(centre_dec))))
    return sphere_distance(dec1 + centre_dec, ra1 / scale, dec2 + centre_dec, ra2 / scale)


def flat_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def pixel_index(x: Column, reference: float, resolution: float) -> Column:
    """Nearest pixel, halves away from zero."""
    return F.round((x - reference) * (1.0 / resolution)).cast("int")


def signed_arc_tan(y: Column, x: Column) -> Column:
    """Polar angle in [0, 2 pi); 0 at the origin."""
    return F.when((x == 0) & (y == 0), 0.0).otherwise(F.pmod(F.atan2(y, x), F.lit(2 * 3.141592653589793)))


def erfc_normal(z: Column) -> Column:
    """Two-sided tail probability of a standard normal, by the rational approximation of Abramowitz and Stegun 7.1.28."""
    x = F.abs(z) / F.lit(2.0**0.5)
    p = F.lit(0.0000430638)
    for c in (0.0002765672, 0.0001520143, 0.0092705272, 0.0422820123, 0.0705230784, 1.0):
        p = p * x + F.lit(c)
    return F.pow(p, F.lit(-16.0))


def nearly_equal(a: Column, b: Column, relative: float = 1e-8) -> Column:
    tiny = 2.2250738585072014e-308
    return (F.abs(a - b) < tiny) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def beam_width(frequency_ghz: float, telescope: str) -> float:
    """Half-power beam width in degrees."""
    return 1.22 * LIGHT * 180.0 / (frequency_ghz * 1e9 * DISHES[telescope] * 3.141592653589793)


def coordinate_system(header: Column) -> Column:
    return F.when(header.contains("RA_DEC"), "equatorial").when(header.contains("LNG_LAT"), "galactic")


def number(text: Column) -> Column:
    """The text as a number, 0 where it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def map_pattern(mode: Column) -> Column:
    """Map type and scan direction of an observing mode; both NULL where it is no map."""
    m = F.lower(mode)
    kind = F.when(m.contains("daisy"), "daisy").when(m.contains("nod"), "nodding").when(m.contains("map") | m.contains("raster"), "raster")
    along = F.when(kind.isNotNull(), m.contains("ra") & ~m.contains("dec") | m.contains("lon"))
    return F.struct(kind.alias("map_type"), along.alias("scans_in_ra"))


def unset(x: Column) -> Column:
    """NULL for the encodings of a missing number: NaN and plus or minus 999999."""
    return F.when(~F.isnan(x) & (F.abs(x) != 999999.0), x)
