"""Maps and tables as files. Parquet is the sink for data of any size; FITS and text layers hold one map each."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.sources import fits


def layer_rows(pixels: DataFrame, layer: str, n_x: int) -> DataFrame:
    """One row of text a map row, right ascension reversed, numbers joined by tabs, nan where there is none."""
    text = F.coalesce(F.when(~F.isnan(layer), F.col(layer).cast("string")), F.lit("nan"))
    rows = pixels.groupBy("y_pix").agg(F.array_sort(F.collect_list(F.struct((F.lit(n_x - 1) - F.col("x_pix")).alias("k"), text.alias("v")))).alias("cells"))
    return rows.select("y_pix", F.array_join(F.transform("cells", lambda c: c["v"]), "\t").alias("line"))


TEXT_LAYERS = ("flux", "weight", "weight2", "correlation", "scale", "path")


def write_text_layers(pixels: DataFrame, folder: str) -> None:
    """A folder of text for each layer that the map has."""
    n_x = pixels.agg(F.max("x_pix")).first()[0]
    for layer in TEXT_LAYERS if n_x is not None else ():
        if layer in pixels.columns:
            write_text_layer(pixels, layer, n_x + 1, f"{folder}/{layer}")


def write_text_layer(pixels: DataFrame, layer: str, n_x: int, path: str) -> None:
    """A map's layer as text, a line a map row."""
    layer_rows(pixels, layer, n_x).sort("y_pix").select("line").write.mode("overwrite").text(path)


def map_cards(step: float, x0: float, y0: float, n_x: int, **rest) -> dict:
    """World coordinate cards of a tangent projection, right ascension falling, and RC cards of the job."""
    cards = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRPIX1": float(n_x), "CRPIX2": 1.0, "CRVAL1": x0, "CRVAL2": y0, "CDELT1": -step, "CDELT2": step, "CUNIT1": "deg", "CUNIT2": "deg"}
    return cards | {f"RC{k.upper()}"[:8]: v for k, v in rest.items()}


def write_fits(pixels: DataFrame, path: str, cards: dict, layers: tuple[str, ...] = ("flux", "path", "scale", "weight", "correlation")) -> None:
    """One FITS file. A map is a bounded picture (pixels of one field), so its layers come to the driver."""
    present = [c for c in layers if c in pixels.columns]
    pdf = pixels.select("x_pix", "y_pix", *present).toPandas()
    n_x, n_y = int(pdf["x_pix"].max()) + 1, int(pdf["y_pix"].max()) + 1
    out = {}
    for c in present:
        data = np.full((n_y, n_x), np.nan)
        data[pdf["y_pix"], n_x - 1 - pdf["x_pix"]] = pdf[c].astype(float)
        out["main" if c == "flux" else c] = data
    with open(path, "wb") as f:
        f.write(fits.image_file(out, cards))


def job_cards(job, beam: float, frequency: float) -> dict:
    """The settings of a job that its map's RC cards tell."""
    kept = ("channel", "receiver", "calibration", "coordinates", "pattern", "telescope", "background_scale", "rfi_scale", "weight_scale", "pixel_scale", "time_shift", "trim")
    short = {"background_scale": "bgscal", "rfi_scale": "rfiscl", "weight_scale": "wscale", "pixel_scale": "pixscl", "calibration": "calib", "coordinates": "coord", "time_shift": "tshift", "telescope": "telesc", "receiver": "recvr", "pattern": "patrn", "channel": "chan"}
    return {short.get(k, k): getattr(job, k) for k in kept if getattr(job, k) is not None} | {"beam": beam, "freq": frequency}


def write_map_file(pixels: DataFrame, path: str, step: float, settings: dict) -> None:
    """A job's map with world coordinates, their reference at the middle pixel, and its settings as one FITS file."""
    b = pixels.agg(F.max("x_pix").alias("x"), F.max("y_pix").alias("y")).first()
    if b["x"] is None:
        return
    x, y = b["x"] // 2, b["y"] // 2
    # a map has a row a pixel of its footprint, so the nearest one to the middle stands for it
    m = pixels.select("x_pix", "y_pix", "ra", "dec").orderBy((F.col("x_pix") - x) ** 2 + (F.col("y_pix") - y) ** 2, "y_pix", "x_pix").first()
    cards = map_cards(step, m["ra"], m["dec"], b["x"] + 1, **settings) | {"CRPIX1": float(b["x"] + 1 - m["x_pix"]), "CRPIX2": float(m["y_pix"] + 1)}
    if settings.get("coord") == "galactic":
        cards |= {"CTYPE1": "GLON-TAN", "CTYPE2": "GLAT-TAN"}
    write_fits(pixels, path, cards)


def validated_path(path: str, process: str = "validated") -> str:
    base, ext = os.path.splitext(path)
    return f"{base}_{process}{ext}"


def write_validated(spectra: DataFrame, folder: str, process: str = "validated") -> DataFrame:
    """Writes the spectra of each file (its column path) as a FITS table `<base>_<process>.fits` below the folder, which all executors must
    share, and returns path and written, the new file. Executors write their files under other names and rename them when they
    are whole, so a task that is lost or repeated leaves no torn file. Channels cut away before stay cut; their number is in the header."""
    schema = "path string, written string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        name = validated_path(os.path.join(folder, os.path.basename(pdf["path"].iloc[0])), process)
        names = {"t": "UTSECS", "dec": "CRVAL3", "az": "AZIMUTH", "el": "ELEVATIO", "dumps": "NSAMPS", "cal_state": "CALSTATE", "sweep": "SWPINDEX", "valid": "SWPVALID", "cdelt": "CDELT1", "if_num": "IFNUM", "pol_num": "PLNUM", "obs_freq": "OBSFREQ"}
        columns = {to: pdf[c].to_numpy() for c, to in names.items()} | {"CRVAL2": pdf["ra"].to_numpy() * 15, "DATA": np.array([[np.nan if v is None else v for v in d] for d in pdf["data"]], float)}
        first, channels = int(pdf["first_channel"].iloc[0]), int(pdf["channels"].iloc[0])
        raw = fits.table_file({"TELESCOP": "20m", "FIRSTCH": first, "CHANNELS": channels}, columns, history=[f"PROCESS {process}"])
        os.makedirs(folder, exist_ok=True)
        part = f"{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, name)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "written": [name]})

    return spectra.groupBy("path").applyInPandas(run, schema)


def remove_validated(folder: str, dry_run: bool = True) -> list[str]:
    """Files *_validated.fits below the folder; they are deleted unless it is a dry run."""
    found = [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith("_validated.fits")]
    if not dry_run:
        for f in found:
            os.remove(f)
    return sorted(found)
