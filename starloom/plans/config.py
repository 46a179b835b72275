"""Job settings: frozen dataclasses, read from TOML or the command line."""

from __future__ import annotations

import argparse
import tomllib
from dataclasses import dataclass, field, fields

from starloom.functions.scalar import DISHES

CHANNELS = ("left", "right", "composite")
RECEIVERS = ("hi", "lo")
CALIBRATIONS = ("pre", "post", "interpolated", "auto", "none")
PATTERNS = ("raster", "daisy", "nodding", "drift")
COORDINATES = ("equatorial", "galactic")
SHIFTS = ("auto", "custom", "off")
CENTROIDS = ("center", "brightest", "coordinates", "detected")
#: Interference scales in beams for fields with bright and with faint sources.
PRESETS = {"bright": 0.35, "faint": 0.7}


@dataclass(frozen=True)
class Job:
    """One map. Scales are in beams; a scale of 0 and a stage's own skip flag both leave the stage out.

    pattern and telescope, left out, are what the first file's header says (raster and 20m, if it is silent). The
    calibration `auto` interpolates the gain only where it drifts. gain_start and gain_end replace the noise signal's
    heights in both channels; -999 is none. places are the sources' coordinates for the centroid `coordinates`; `detected`
    takes all places that stand `detect_limit` scatters out of the samples. `level` takes the offsets of overlapping surveys off
    large-scale and raw maps. `extra_models` fits interference
    models on a grid around detected sources too; `text` writes layers as text. `smooth_large_scale` maps smooth surfaces through the large-scale data. `paired` text files of the 40 foot telescope are channels of one survey; `validate` maps the
    validated copies of SDFITS files, which are written beside the output.
    large_scale adds a map of the background; fits writes every map as FITS too.
    """

    filenames: tuple[str, ...] = ()
    output: str = "map"
    channel: str = "composite"
    receiver: str = "hi"
    calibration: str = "interpolated"
    coordinates: str = "equatorial"
    time_shift: str = "auto"
    time_shift_value: float = 0.0
    raw_map: bool = False
    include: tuple[tuple[float, float], ...] = ()
    exclude: tuple[tuple[float, float], ...] = ()
    background_scale: float = 6.0
    rfi_scale: float = 0.7
    weight_scale: float = 1 / 3
    noise_prior: bool = False
    pixel_scale: float = 0.05
    photometry: bool = False
    inner_radius: float = 1.25
    outer_radius: float = 5.0
    centroid: str = "brightest"
    places: tuple[tuple[float, float], ...] = ()
    sources: int = 1
    detect_limit: float = 75.0
    level: bool = False
    smooth_large_scale: bool = False
    extra_models: bool = False
    text: bool = False
    paired: bool = False
    validate: bool = False
    trim: float = 0.0
    large_scale: bool = False
    gain_start: float | None = None
    gain_end: float | None = None
    pattern: str | None = None
    telescope: str | None = None
    fits: bool = False
    skip_time_shift: bool = False
    skip_background: bool = False
    skip_rfi: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for value, allowed in ((self.channel, CHANNELS), (self.receiver, RECEIVERS), (self.calibration, CALIBRATIONS), (self.coordinates, COORDINATES), (self.time_shift, SHIFTS), (self.centroid, CENTROIDS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
        if self.pattern is not None and self.pattern not in PATTERNS:
            raise ValueError(f"{self.pattern!r} is none of {', '.join(PATTERNS)}")
        if self.telescope is not None and self.telescope not in DISHES:
            raise ValueError(f"{self.telescope!r} is none of {', '.join(DISHES)}")
        if self.photometry and self.centroid == "coordinates" and not self.places:
            raise ValueError("the centroid `coordinates` needs places")
        for name in ("background_scale", "rfi_scale", "weight_scale", "trim"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        for low, high in (*self.include, *self.exclude):
            if not low < high:
                raise ValueError(f"a band from {low} to {high}")


def _pairs(values) -> tuple[tuple[float, float], ...]:
    flat = [float(v) for v in values]
    return tuple(zip(flat[::2], flat[1::2]))


def from_mapping(settings: dict) -> Job:
    """A job from plain settings; names that no field has are kept in `extra`."""
    known = {f.name for f in fields(Job)}
    out = {k: v for k, v in settings.items() if k in known}
    for k in ("include", "exclude", "places"):
        if k in out and out[k] and not isinstance(out[k][0], (list, tuple)):
            out[k] = _pairs(out[k])
        elif k in out:
            out[k] = tuple((float(a), float(b)) for a, b in out[k])
    if "filenames" in out:
        out["filenames"] = tuple(out["filenames"])
    if (preset := settings.get("preset")) is not None:
        out.setdefault("rfi_scale", PRESETS[preset])
    return Job(**out, extra={k: v for k, v in settings.items() if k not in known and k != "preset"})


def load(path: str) -> Job:
    """A job from a TOML file: [input] with filenames and one table of settings."""
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    settings = dict(doc.get("input", {}))
    for name, part in doc.items():
        if name != "input" and isinstance(part, dict):
            settings |= part
    return from_mapping(settings)


def from_arguments(argv: list[str]) -> Job:
    """A job from named arguments: files, then --field value for any field of Job."""
    p = argparse.ArgumentParser()
    p.add_argument("filenames", nargs="+")
    for f in fields(Job):
        if f.name in ("filenames", "extra"):
            continue
        name = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(name, action="store_true")
        elif "tuple" in str(f.type):
            p.add_argument(name, type=float, nargs="*", default=[])
        else:
            p.add_argument(name, type={"int": int, "str": str, "str | None": str}.get(str(f.type), float), default=None)
    found = {k: v for k, v in vars(p.parse_args(argv)).items() if v not in (None, [])}
    return from_mapping(found)
