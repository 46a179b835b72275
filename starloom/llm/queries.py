"""The thin queries over whole tables that apply each operator, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import alignment, fingerprint, html, huffman, licenses, markov, neardup, packing, periodic, pieces, quality, secrets, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated windows of 35 go; what is left of each document."""
    found = substring.remove_repeated(_documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", "substring.n_words", "substring.n_removed", F.sha2("substring.kept", 256).alias("kept_sha256"), F.size("substring.spans").alias("n_spans"))


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document through the stored ledger of blobs."""
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS))
    return found.select("doc_id", *(count(k) for k in secrets.KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser fertility and the verdict for every document."""
    found = quality.measure(_documents(spark, sf_dir).select("doc_id", "text", "lang"), carry=["doc_id"])
    return found.select("doc_id", *(f"quality.{f.name}" for f in quality.FIELDS))


@_query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a Jaccard similarity of 0.8 or more."""
    return neardup.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), neardup.Params(shingle=2)).drop("a", "b")


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces packed into sequences of 2048 tokens."""
    return packing.pack(packing.pieces(_documents(spark, sf_dir).select("doc_id", "text")))


@_query
def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as Huffman blocks and read back."""
    return huffman.round_trip(_documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, source spans and decoding of every document."""
    found = pieces.encode(_documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"], digests=True)
    return found.select("doc_id", "pieces.n_tokens", "pieces.ids_sha256", F.sha2("pieces.decoded", 256).alias("decoded_sha256"), "pieces.spans_sha256", F.col("pieces.covered").alias("n_bytes_covered"))


@_query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), carry=["page_id", "url"])
    return found.select("page_id", "url", "main.text", "main.n_chars")


@_query
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.compare_with_next(_documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, as a whole text and by line, through canonical digests."""
    found = licenses.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.withColumn("notices", F.array_join("notices", ","))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """documents as the periodic query reads them: where crc32(doc_id) is a multiple of ten, the words from some place on repeat the
    first few of them. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and what is left when each is cut to its first period."""
    found = periodic.collapse(_with_repeats(_documents(spark, sf_dir).select("doc_id", "text")), carry=["doc_id"])
    best, line = F.col("periodic.best"), lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))
    lines = F.array_join(F.transform("periodic.runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
        F.col("periodic.n_words").alias("n_words"),
    )


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-level and piece tokens that end together in every document, and how often their links occur in all of them."""
    found = alignment.corpus_links(_documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"], digests=True)
    return found.select("doc_id", *(f"aligned.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")))


@_query
def op11_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a hidden Markov model and a smoothed unigram of the training documents."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", markov.held_out("doc_id").alias("held_out"))
    return markov.score(docs, carry=["doc_id", "held_out"]).select("doc_id", "held_out", *(f"score.{f.name}" for f in markov.FIELDS))


ORACLES["op2_license_scan"] = licenses.oracle()
