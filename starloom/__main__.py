"""python -m starloom FILE... [--field value ...] [--output PATH]: runs a mapping job and writes its products as Parquet, and
maps as FITS if asked for. Beam and pattern come from the first file's header, unless they are set."""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from starloom.functions.scalar import beam_width
from starloom.plans import config, mapping, validation
from starloom.sources import readers, sinks


def main(argv: list[str]) -> None:
    job = config.load(argv[0]) if argv and argv[0].endswith(".toml") else config.from_arguments(argv)
    spark = SparkSession.builder.appName("starloom").getOrCreate()
    known = readers.describe(spark, job.filenames[0]) if job.telescope != "40ft" or ".fits" in job.filenames[0] else {"telescope": "40ft"}
    telescope = job.telescope or known["telescope"]
    job = replace(job, telescope=telescope, pattern=job.pattern or ("drift" if telescope == "40ft" else known.get("map_type") or "raster"))
    files = list(job.filenames)
    if job.validate:
        tables = [f for f in files if ".fits" in f]
        copies = sinks.write_validated(validation.validate(spark, tables), f"{job.output}/validated") if tables else None
        made = {r["path"]: r["written"] for r in copies.collect()} if copies else {}
        files = [made.get(readers.qualified(spark, f), f) for f in files]
    raw = readers.read_observations(spark, files, telescope, job.paired)
    frequency = float(job.extra.get("frequency", known.get("frequency", 1.395)))
    beam = beam_width(frequency, telescope)
    if "data" in raw.columns:
        raw = mapping.integrate(raw, job)
    for name, df in mapping.run(spark, raw, job, beam).items():
        df.write.mode("overwrite").parquet(f"{job.output}/{name}")
        if job.text and name != "sources":
            sinks.write_text_layers(spark.read.parquet(f"{job.output}/{name}"), f"{job.output}/{name}-text")
        if job.fits and name != "sources":
            pixels = spark.read.parquet(f"{job.output}/{name}")
            sinks.write_map_file(pixels, f"{job.output}/{name}.fits", job.pixel_scale * beam, sinks.job_cards(job, beam, frequency))


if __name__ == "__main__":
    main(sys.argv[1:])
