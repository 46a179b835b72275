"""Licence scans by canonical digest.

A text is made canonical (case, punctuation and white space, copyright lines, equivalent spellings, a title before
the terms, and the holder's name in the clauses that hold one) and its SHA-256 is joined to the digests of known licence texts; lines are looked up likewise, against the
same table, for one-line notices. Everything is a Column expression; texts are never compared or
shuffled, only digests are. The known side is a table of any size; it is broadcast only after its rows were counted.

Defined results: null text is empty; an empty canonical text matches nothing; of several known licences with
the same canonical text the least id is given; rows with the same id and text share their result; extra
columns of docs are ignored, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats alike.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("https:", "http:"),
)
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
# Parts of licence texts that may vary (the holder's name), in canonical form, and what stands for them.
VARIABLES = (
    (r"neither the names? of .{1,160}? nor the names? of (?:its |their |the |any |other |said )?contributors", "neither the name of holder nor the names of contributors"),
    (r"provided by .{1,120}? as is and", "provided by holder as is and"),
    (r"in no event shall .{1,120}? be liable", "in no event shall holder be liable"),
)
#: A title before the terms, which a text may leave out.
TITLE = (
    r"^(?:the )?(?:(?:new|modified|simplified|revised|original) )?(?:mit|isc|x11|expat|bsd|bsd [0-4] clause|[0-4] clause bsd|zlib|curl|boost software) license"
    r"(?: version [0-9a-z ]{1,30}?| mit| isc| expat)? (permission is|permission to|redistribution and use|this software is)"
)
BROADCAST_ROWS = 100_000
MARKS = r"[^\p{L}\p{N}]+"

# Public licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


def _full_texts() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of the files in known_licenses, with and without what follows the end of the terms."""
    found = []
    for path in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        license_id, text = path.stem.removesuffix("-UC"), path.read_text(encoding="utf-8")
        found.append((license_id, text))
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        if end and rest.strip():
            found += [(license_id, terms + end), (license_id, terms)]
    return tuple(found)


KNOWN += _full_texts()


def canonical(text: Column) -> Column:
    """The text as matching sees it; null as empty."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.trim(F.regexp_replace(c, MARKS, " "))
    for pattern, name in VARIABLES:
        c = F.regexp_replace(c, pattern, name)
    return F.regexp_replace(c, TITLE, "$1")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(known_digest, license_id) of a table with license_id and text; the built-in texts by default. Up to
    BROADCAST_ROWS known texts (about 100 bytes each, once hashed) are broadcast; more are joined by a shuffle."""
    known = known if known is not None else spark.createDataFrame(list(KNOWN), "license_id string, text string")
    rows = known.select(digest(F.col("text")).alias("known_digest"), "license_id").filter(canonical(F.col("text")) != "")
    table = rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(table) if rows.count() <= BROADCAST_ROWS else table


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, canonical_sha256, license_id of the whole text (null: none known),
    and notices, the sorted license ids of its lines."""
    table = known_digests(docs.sparkSession, known)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("b")]
    rows = docs.select(F.col(id_col).alias("id"), *keys, digest(text).alias("canonical_sha256"))
    units = docs.select(*keys, digest(text).alias("whole"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), digest))).alias("line"))
    lines = units.join(table, units["line"] == table["known_digest"]).groupBy("a", "b").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    lines = lines.select(F.col("a").alias("la"), F.col("b").alias("lb"), "notices")
    found = rows.join(table, rows["canonical_sha256"] == table["known_digest"], "left")
    found = found.join(lines, (F.col("a") == F.col("la")) & (F.col("b") == F.col("lb")), "left")
    return found.select(F.col("id").alias(id_col), "canonical_sha256", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def oracle() -> str:
    """The same scan of `documents` in DuckDB SQL."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        c = f"regexp_replace(lower(coalesce({x}, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
        for a, b in SPELLINGS:
            c = f"replace({c}, {quote(a)}, {quote(b)})"
        c = f"trim(regexp_replace({c}, {quote(MARKS)}, ' ', 'g'))"
        for pattern, name in VARIABLES:
            c = f"regexp_replace({c}, {quote(pattern)}, {quote(name)}, 'g')"
        return f"regexp_replace({c}, {quote(TITLE)}, '\\1')"

    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canon("t")}) AS d, min(i) AS license_id FROM (VALUES {rows}) v(i, t) GROUP BY 1),
units AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
lines AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
          FROM units JOIN known ON sha256({canon("line")}) = d GROUP BY doc_id)
SELECT x.doc_id, sha256({canon("x.text")}) AS canonical_sha256, k.license_id, coalesce(l.notices, '') AS notices
FROM documents x LEFT JOIN known k ON sha256({canon("x.text")}) = k.d LEFT JOIN lines l ON l.doc_id = x.doc_id
"""
