"""Observations as DataFrames of samples. Files are read by Spark's own sources, so any store it knows will do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions.scalar import number
from starloom.operators.ordered import sticky_unwrap
from starloom.sources import fits

SAMPLES = "path string, row_id bigint, t double, ra double, dec double, az double, el double, flux_l double, flux_r double, dumps double, cal_state int, sweep int, valid int"
SPECTRA = "path string, row_id bigint, t double, ra double, dec double, az double, el double, dumps double, cal_state int, sweep int, valid int, cdelt double, if_num int, pol_num int, obs_freq double, first_channel int, channels int, data array<double>"


def parse_history(lines: list[str]) -> dict:
    """Settings in HISTORY lines: `KEY a,b` and `KEY=...` as numbers, lists or text; what fits neither goes to `_extra`."""
    out: dict = {"_extra": []}
    for line in lines:
        m = re.match(r"\s*([A-Za-z][A-Za-z0-9_,]*)\s*[=:\s]\s*(.+?)\s*$", line)
        if not m:
            out["_extra"].append(line.strip())
            continue
        parts = [p for p in re.split(r"[,\s]+", m[2].strip("[]()")) if p]
        values = [float(p) if re.fullmatch(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", p) else p for p in parts]
        keys = m[1].split(",")
        if len(keys) > 1 and len(keys) == len(values):
            out |= dict(zip(keys, values))
        else:
            out[m[1]] = values[0] if len(values) == 1 else values
    return out


def channel_range(history: list[str], channels: int) -> tuple[int, int]:
    """First channel, from 0, and the one after the last of the range that a START,STOP line names (from 1, both included); all without one."""
    for line in history:
        m = re.search(r"START,STOP\D*(\d+)\D+(\d+)", line)
        if m and 1 <= int(m[1]) <= int(m[2]) <= channels:
            return int(m[1]) - 1, int(m[2])
    return 0, channels


def telescope(header: dict) -> str:
    """20m, gbt or 40ft by the primary header."""
    name = str(header.get("TELESCOP", "")).lower()
    if "gbt" in name or "green bank" in name and "20" not in name:
        return "gbt"
    return "40ft" if "40" in name else "20m"


def frequency_range(header: dict, history: dict) -> tuple[float, float]:
    """Low and high edge of the observed band in MHz: half the bandwidth on both sides of the centre, cut to a filter's band if one is named."""
    centre, width = float(header["OBSFREQ"]), float(header["OBSBW"])
    low, high = centre - width / 2, centre + width / 2
    band = history.get("RFFILTER")
    if isinstance(band, list) and len(band) == 2 and all(isinstance(b, float) for b in band):
        low, high = max(low, band[0]), min(high, band[1])
    return low, high


def gbt_seconds(date_obs: str) -> float:
    """Seconds of the day of an ISO time."""
    h, m, s = date_obs.split("T")[1].split(":")
    return int(h) * 3600 + int(m) * 60 + float(s)


def observation_year(date: str) -> int:
    return int(date.split("-")[0])


def _sdfits_rows(kind: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                primary, _, c = fits.table(bytes(raw))
                what = kind or telescope(primary)
                n = len(next(iter(c.values())))
                get = lambda name, default: np.asarray(c[name], float) if name in c else np.full(n, float(default))  # noqa: E731, B023
                time = np.array([gbt_seconds(x) for x in c["DATE-OBS"]]) if "UTSECS" not in c else get("UTSECS", 0)
                sweep = get("PROCSEQN", 1) - 1 if what == "gbt" else get("SWPINDEX", 0)
                data = np.asarray(c["DATA"], float).reshape(n, -1)
                channels = data.shape[1]
                first, last = channel_range(primary.get("HISTORY", []), channels)
                data = data[:, first:last]
                if "CHANNELS" in primary:
                    # a validated copy, whose channels were cut before
                    first, channels = first + primary["FIRSTCH"], primary["CHANNELS"]
                yield pd.DataFrame({
                    "path": path, "row_id": np.arange(n), "t": time, "ra": get("CRVAL2", 0) / 15.0, "dec": get("CRVAL3", 0), "az": get("AZIMUTH", 0), "el": get("ELEVATIO", 0),
                    "dumps": get("NSAMPS", 1) if what != "gbt" else np.ones(n), "cal_state": (get("CALSTATE", 0) if what != "gbt" else np.zeros(n)).astype("int32"),
                    "sweep": sweep.astype("int32"), "valid": (get("SWPVALID", 1) if what != "gbt" else np.ones(n)).astype("int32"), "cdelt": get("CDELT1", 0),
                    "if_num": get("IFNUM", 0).astype("int32"), "pol_num": get("PLNUM", 0).astype("int32"), "obs_freq": get("OBSFREQ", 0), "first_channel": first, "channels": channels, "data": list(data),
                })

    return run


def read_sdfits(spark: SparkSession, paths: str | list[str], kind: str | None = None) -> DataFrame:
    """Spectra of SDFITS files (extension SINGLE DISH); right ascension in hours. A file is one task's work. Channels that the HISTORY's
    START,STOP leaves out are not read; first_channel and channels tell where the others lay.

    kind: 20m, 40ft or gbt; the primary header says which, if not given. Columns that a telescope lacks have its constants.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_sdfits_rows(kind), SPECTRA)


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and header (map<string,string>) of FITS files, with their HISTORY lines joined by newlines."""

    def run(batches):
        for pdf in batches:
            heads = [fits.read_header(bytes(raw), 0)[0] for raw in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "header": [{k: "\n".join(v) if isinstance(v, list) else str(v) for k, v in h.items()} for h in heads]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, header map<string,string>")


def find_files(spark: SparkSession, folder: str, glob: str = "*.fits") -> DataFrame:
    """Paths below a folder, without files that validation has made."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return found.select("path").filter(~F.col("path").contains("_validated"))


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with their number in the file. A file is read whole, as observing logs are small."""
    files = spark.read.format("binaryFile").load(path).select("path", F.split(F.decode("content", "UTF-8"), "\r?\n").alias("lines"))
    return files.select("path", F.posexplode("lines").alias("line_no", "line"))


def read_ascii_header(spark: SparkSession, path: str) -> DataFrame:
    """path, scan_type, frequency (GHz), mjd, map_coord from the # lines of 20 m text files."""
    head = _numbered(spark, path).filter(F.col("line").startswith("#"))
    get = lambda pattern: F.max(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    out = head.groupBy("path").agg(get(r"SCANTYPE\s*=?\s*(\S+)").alias("scan_type"), get(r"OBSFREQ\s*=\s*([\d.]+)").alias("f"), get(r"MJD\s*=\s*(\d+)").alias("mjd"), get(r"COORDREF\s*=?\s*(\S+)").alias("map_coord"))
    return out.select("path", "scan_type", (F.col("f").cast("double") / 1000).alias("frequency"), F.col("mjd").cast("int").alias("mjd"), "map_coord")


def read_ascii(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Samples of 20 m text files (.txt, .md2): 11 numbers a line; lines with fewer or more are dropped. Time and right
    ascension are unwrapped over midnight and over 24 hours."""
    parts = _numbered(spark, path).filter(~F.col("line").startswith("#")).select("path", "line_no", F.split(F.trim("line"), r"\s+").alias("p")).filter(F.size("p") == 11)
    names = ["t", "ra", "dec", "az", "el", "flux_l", "flux_r", "dumps", "cal_state", "sweep", "valid"]
    kinds = {"cal_state": "int", "sweep": "int", "valid": "int"}
    rows = parts.select("path", F.col("line_no").cast("bigint").alias("row_id"), *[number(F.col("p")[i]).cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(names)])
    rows = rows.withColumn("t", F.when(F.col("t") > 86400, F.col("t") - 86400).otherwise(F.col("t")))
    rows = sticky_unwrap(rows, ["path"], "row_id", "t", 86400.0, "t__").withColumn("t", F.col("t__")).drop("t__")
    w = Window.partitionBy("path")
    both = (F.min("ra").over(w) < 1) & (F.max("ra").over(w) > 23)
    return rows.withColumn("ra", F.when(both & (F.col("ra") < 12), F.col("ra") + 24).otherwise(F.col("ra"))).select(*[x.split()[0] for x in SAMPLES.split(", ")])


def read_forty(spark: SparkSession, path: str | list[str], second: dict[str, str] | None = None) -> DataFrame:
    """Samples of 40-foot text files: three lines (time, declination, flux) a record; a `*` ends a section and `**` a
    calibration. Section 0 is calibration on, 1 off; later sections are scans 0, 1, ... (-1 for calibration).
    `second` names, for each path as Spark tells it, the file that gives the right channel, line for line. The telescope does not
    turn, so the sidereal time is the right ascension.
    """

    def records(p: str | list[str], value: str) -> DataFrame:
        w = Window.partitionBy("path").orderBy("line_no")
        lines = _numbered(spark, p).filter(F.trim("line") != "")
        marked = lines.withColumn("star", F.trim("line").startswith("*").cast("int"))
        marked = marked.withColumn("section", F.sum("star").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("star = 0")
        order = Window.partitionBy("path", "section").orderBy("line_no")
        k = marked.withColumn("k", F.row_number().over(order) - 1)
        pick = lambda i, name: F.max(F.when(F.col("k") % 3 == i, number(F.trim("line")))).alias(name)
        return k.groupBy("path", "section", F.floor(F.col("k") / 3).alias("r")).agg(pick(0, "t"), pick(1, "dec"), pick(2, value), F.count("*").alias("n")).filter("n = 3").drop("n")

    rows = records(path, "flux_l")
    if second:
        of = _by_path(spark, {b: a for a, b in second.items()}, "left__", "string")
        right = records(list(second.values()), "flux_r").join(F.broadcast(of), F.col("path") == F.col("path__"))
        right = right.select("left__", F.col("section").alias("s__"), F.col("r").alias("r__"), "flux_r")
        rows = rows.join(right, (F.col("path") == F.col("left__")) & (F.col("section") == F.col("s__")) & (F.col("r") == F.col("r__")), "left").drop("left__", "s__", "r__")
    else:
        rows = rows.withColumn("flux_r", F.col("flux_l"))
    rows = rows.withColumn("row_id", F.row_number().over(Window.partitionBy("path").orderBy("section", "r")).cast("bigint") - 1)
    rows = sticky_unwrap(rows, ["path"], "row_id", "t", 86400.0, "t__").withColumn("t", F.col("t__"))
    state = F.when(F.col("section") == 0, 1).when(F.col("section") == 1, 0).otherwise(-1)
    zero = F.lit(0.0)
    return rows.select("path", "row_id", "t", (F.col("t") / 3600).alias("ra"), "dec", zero.alias("az"), zero.alias("el"), "flux_l", "flux_r", F.lit(1.0).alias("dumps"), state.alias("cal_state"), F.greatest(F.col("section") - 2, F.lit(-1)).cast("int").alias("sweep"), (F.col("section") >= 2).cast("int").alias("valid"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers tell it, with its store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _by_path(spark: SparkSession, values: dict, name: str, kind: str) -> DataFrame:
    """path__ and a value for each file of a job; as many rows as the job names files."""
    return spark.createDataFrame([(p, v) for p, v in values.items()], f"path__ string, {name} {kind}")


def kind_of(path: str, telescope: str | None = None) -> str:
    """fits, ascii or forty by a file's name; other names raise. A text file of the 40 foot telescope is told by `telescope`."""
    if ".fits" in path:
        return "fits"
    if telescope == "40ft":
        return "forty"
    if ".txt" in path or ".md2" in path:
        return "ascii"
    raise ValueError(f"neither .fits nor .txt nor .md2: {path}")


def read_observations(spark: SparkSession, paths: list[str], telescope: str | None = None, paired: bool = False) -> DataFrame:
    """All files, tagged by survey_id in their order. Files of a kind are one scan, whatever their number, and their surveys are joined by path.

    With `paired`, text files of the 40 foot telescope come in twos, the left and the right channel of one survey.
    """
    kinds = [kind_of(p, telescope) for p in paths]
    places = [qualified(spark, p) for p in paths]
    if len(set(places)) < len(places):
        raise ValueError("a file is named twice")
    second, surveys = {}, {}
    forty = [p for p, k in zip(places, kinds) if k == "forty"]
    if paired and forty:
        if len(forty) % 2:
            raise ValueError("paired files come in twos")
        second = dict(zip(forty[::2], forty[1::2]))
    for place in places:
        if place not in second.values():
            surveys[place] = len(surveys)
    read = {"fits": read_sdfits, "ascii": read_ascii, "forty": lambda s, p: read_forty(s, p, second or None)}
    out = None
    for kind in dict.fromkeys(kinds):
        rows = read[kind](spark, [p for p, k in zip(places, kinds) if k == kind and p in surveys])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.join(F.broadcast(_by_path(spark, surveys, "survey_id", "int")), F.col("path") == F.col("path__")).drop("path__")


def describe(spark: SparkSession, path: str) -> dict:
    """telescope, frequency (GHz, corrected by year), band (MHz) and map_type of an observation, as far as its header says."""
    from starloom.functions.scalar import map_pattern
    from starloom.operators.segment import corrected_frequency

    out: dict = {}
    if ".fits" in path:
        head = dict(read_headers(spark, path).first()["header"])
        out["telescope"] = telescope(head)
        if "OBSFREQ" in head:
            year = observation_year(head["DATE"]) if "DATE" in head else 9999
            out["frequency"] = corrected_frequency(float(head["OBSFREQ"]) / 1000, year)
        if "OBSFREQ" in head and "OBSBW" in head:
            out["band"] = frequency_range(head, parse_history(head.get("HISTORY", "").split("\n")))
        mode = head.get("OBSMODE")
    else:
        row = read_ascii_header(spark, path).first()
        out, mode = {"telescope": "20m"}, row and row["scan_type"]
        if row and row["frequency"] is not None:
            out["frequency"] = row["frequency"]
    if mode:
        kind = spark.range(1).select(map_pattern(F.lit(mode)).alias("k")).first()["k"]
        out["map_type"] = kind["map_type"]
    return out
