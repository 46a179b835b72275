"""A training-corpus pipeline of five operators over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage's result is written to the shared folder and read again as the next one's docs; what it
replaces is deleted.

Defined results, in every stage: null text counts as empty; null ids, languages and sources are ordinary values;
columns that documents does not have, whatever their names, pass through the first four stages unchanged; an empty
table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import neardup, packing, quality, secrets, substring
from starloom.llm.shared import discarding, written


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of docs with another text and the length that goes with it."""
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and short texts go, repeated rows stay repeated."""
    return quality.measure(docs, out="quality__").filter("quality__.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the least
    id, a null id only where no other is there. Of rows that repeat (id and text) one stays; a text without words stays."""
    return neardup.without_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which nothing is left, or that had no words, go, untouched ones
    keep their text as it was. Rows that repeat count as several occurrences, so a text of a window or more loses all."""
    found = substring.remove_repeated(docs, out="substring__")
    text = F.when(F.col("substring__.n_removed") > 0, F.col("substring__.kept")).otherwise(F.col("text"))
    kept = found.filter("substring__.n_words > substring__.n_removed")
    return _with_text(kept.select(*docs.columns, text.alias("text__")).drop("text").withColumnRenamed("text__", "text").select(*docs.columns), F.col("text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, found through the stored ledger of blobs; texts without any, null too, stay as they are."""
    found = secrets.scan(docs, out="spans__")
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans__")))
    return _with_text(masked.select(*docs.columns), F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences, with their ids; a null or empty text is the separator alone,
    rows that repeat are documents of their own."""
    return packing.pack(packing.pieces(docs, with_ids=True))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: Likelihood tests, tokenizers and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with discarding(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
        return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0], keep=True)
