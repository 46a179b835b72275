"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of a text at every path is a blob named by the SHA-256 of its bytes. The ledger is a stored table, keyed by
(rule version, blob): a scan reads what it has of the run's own blobs, scans the blobs it lacks under these rules, appends what it
found (also that it found nothing) and joins the findings back to all paths and versions. So a second scan of the same texts scans
nothing, a new version of a text is one new blob, and new rules, or new code that scans, scan all.

A ledger is kept where `path` or the session's setting starloom.secret.ledger says. With neither, a scan has a ledger of its own in the
shared folder, empty at first and deleted at the end, so that every text is scanned.

How it scales: the run's distinct ids meet the ledger in a semi-join, by broadcast up to BROADCAST_BLOBS of them, so a run
shuffles rows of its own blobs alone, never the ledger's history (beyond that bound ids are shuffled, without spans). Texts stay where they
are: up to BROADCAST_BLOBS unseen ids are sent to the texts, more are joined to them by a shuffle; with an empty ledger all texts
are scanned in place. Copies of a blob are scanned once a task (the task remembers its last SEEN blobs), not once in all, because to claim
a blob for one task would move its text. Only blobs with findings are joined back, by broadcast up to BROADCAST_BLOBS blobs and
BROADCAST_SPANS spans of them; beyond that, blobs with over a thousandth of all rows are joined by broadcast and the others by shuffle, so
no blob brings one task more than that. Appends leave small files; compact() writes them anew.

Defined results: null text is the empty blob and has no findings; equal texts at many paths share
a scan; rows repeated in the input repeat in the output; null ids are kept; an empty table adds nothing to the
ledger; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from starloom.llm.shared import delete, joined_by_hot_key, shared_dir, written
from starloom.llm.text import slices

KINDS = ("assign", "access", "hex")
_SPAN = "struct<kind:string,start:int,end:int>"
LEDGER = f"blob_id binary, spans array<{_SPAN}>, rules_version string"
#: Ids (32 bytes each) or blobs with findings that are broadcast at most, after they were counted.
BROADCAST_BLOBS = 300_000
#: Spans (some 40 bytes each) that are broadcast at most.
BROADCAST_SPANS = 1_000_000
#: The session's setting that names a kept ledger.
SETTING = "starloom.secret.ledger"
#: Ids of blobs that a task remembers.
SEEN = 200_000


@dataclass(frozen=True)
class Rules:
    """A versioned rule set: kind, pattern, least length, the group that has it and, if given, a cheap pattern that every
    finding's text must hold, tested first. The ledger's key is `name`: the version and a digest of the rules and of the code that scans,
    so changed rules or code never read the findings of others."""

    version: str = "base-1"
    rules: tuple[tuple[str, str, int, int] | tuple[str, str, int, int, str], ...] = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, r"(?i:passw|secret|token|api_?key)"),
        ("access", r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
        ("hex", r"[0-9a-f]+", 24, 0, r"[0-9a-f]{24}"),
    )

    @property
    def name(self) -> str:
        return f"{self.version}-{hashlib.sha256((repr(self.rules) + inspect.getsource(find_spans)).encode()).hexdigest()[:12]}"


#: Formats of keys whose issuers mark them, beside the base kinds.
EXTENDED = Rules(
    "marked-1",
    (
        ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 1, 0, "PRIVATE KEY"),
        ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 1, 0, "eyJ"),
        ("code_host", r"(?:gh[opsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_-]{20,})", 1, 0, "gh[opsu]_|github_pat_|glpat-"),
        ("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}", 1, 0, "xox"),
        ("payment", r"[rs]k_live_[A-Za-z0-9]{16,}", 1, 0, "_live_"),
        ("cloud", r"AIza[A-Za-z0-9_-]{35}", 1, 0, "AIza"),
    ),
)
BASE = Rules()
ALL = (BASE, EXTENDED)
ORDER = (*KINDS, *(r[0] for r in EXTENDED.rules))


def find_spans(text: str, rules: Rules = Rules()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each finding, in code points, by start, then in the order of the rules."""
    found = []
    for k, (kind, pattern, least, group, *first) in enumerate(rules.rules):
        if first and not re.search(first[0], text, re.ASCII):
            continue
        for m in re.finditer(pattern, text, re.ASCII):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def _scan(rules: tuple[Rules, ...]):
    """Scans each blob once in a task under the versions wanted; a blob that the task remembers yields no row."""
    named = {r.name: r for r in rules}

    def run(batches):
        seen: OrderedDict[bytes, None] = OrderedDict()
        for batch in slices(batches, "text"):
            ids, versions, spans = [], [], []
            for b, wanted, t in zip(*(batch.column(c).to_pylist() for c in ("blob_id", "wanted", "text"))):
                if b in seen:
                    seen.move_to_end(b)
                    continue
                seen[b] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                for v in wanted:
                    ids.append(b)
                    versions.append(v)
                    spans.append([{"kind": k, "start": a, "end": e} for a, e, k in find_spans(t, named[v])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(spans, kind), pa.array(versions, pa.string())], ["blob_id", "spans", "rules_version"])

    return run


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str, rules: tuple[Rules, ...] = ALL) -> DataFrame | None:
    """The ledger's rows under these rules; None where nothing was ever scanned under any."""
    try:
        found = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.filter(F.col("rules_version").isin(*(r.name for r in rules)))


def own_blobs(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text") -> DataFrame | None:
    """The ledger's rows of the blobs of docs, written; None without a ledger."""
    if ledger is None:
        return None
    ids = written(docs.select(blob_id(F.col(text_col)).alias("blob_id")).distinct(), "ids")
    return written(ledger.join(F.broadcast(ids) if ids.count() <= BROADCAST_BLOBS else ids, "blob_id", "left_semi"), "known")


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rules, ...] = ALL, text_col: str = "text") -> DataFrame:
    """New ledger rows for the pairs of a blob of docs and a rule version that the ledger lacks, each pair once."""
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = docs.select(blob_id(F.col(text_col)).alias("blob_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("wanted", names)
    else:
        done = ledger.groupBy("blob_id").agg(F.collect_set("rules_version").alias("done"))
        ids = blobs.select("blob_id").distinct().join(done, "blob_id", "left")
        todo = ids.select("blob_id", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("wanted")).filter(F.size("wanted") > 0)
        todo = written(todo, "unseen")
        blobs = blobs.join(F.broadcast(todo) if todo.count() <= BROADCAST_BLOBS else todo, "blob_id")
    found = blobs.select("blob_id", "wanted", "text").mapInArrow(_scan(rules), LEDGER)
    return found.dropDuplicates(["blob_id", "rules_version"])


def update(docs: DataFrame, path: str, rules: tuple[Rules, ...] = ALL, text_col: str = "text") -> DataFrame:
    """Scans what the ledger at `path` lacks, appends it, and returns the rows of the blobs of docs under these rules."""
    spark = docs.sparkSession
    known = own_blobs(docs, read_ledger(spark, path, rules), text_col)
    new = written(unseen(docs, known, rules, text_col), "scanned")
    new.write.mode("append").partitionBy("rules_version").parquet(path)
    return new if known is None else known.unionByName(new)


def compact(spark: SparkSession, path: str, rows_a_file: int = 1_000_000) -> None:
    """Writes the ledger at `path` anew, each pair once, in files of about `rows_a_file` rows. The new table is complete before the old
    one is moved away, so an end at any moment loses no row: the old one is then at `path` or beside it under `.old`. Nothing else may
    append meanwhile."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    rows = spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob_id", "rules_version"])
    rows.repartition(max(1, -(-rows.count() // rows_a_file)), "rules_version", F.substring("blob_id", 1, 2)).write.partitionBy("rules_version").parquet(fresh)
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.rename(hadoop(path), hadoop(old))
    store.rename(hadoop(fresh), hadoop(path))
    delete(spark, old)


def _by_place(spans: Column) -> Column:
    """Spans by start, then in the order of the kinds."""
    order = F.array(*(F.lit(k) for k in ORDER))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def findings(docs: DataFrame, ledger: DataFrame, text_col: str = "text", out: str = "spans", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all by default) and `out`, the spans that the ledger has for each row's blob under any
    of its rule versions, by start; empty where it has none."""
    names = [c for c in docs.columns if c.lower() != out.lower() and (carry is None or c in carry)]
    # the row as one column, so no name of docs can clash
    paths = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), blob_id(F.col(text_col)).alias("blob"))
    known = ledger.filter(F.size("spans") > 0).groupBy(F.col("blob_id").alias("known")).agg(_by_place(F.flatten(F.collect_list("spans"))).alias("found"))
    known = written(known, "findings")
    blobs, spans = known.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    if blobs <= BROADCAST_BLOBS and spans <= BROADCAST_SPANS:
        joined = paths.join(F.broadcast(known), F.col("blob") == F.col("known"), "left")
    else:
        joined = joined_by_hot_key(paths, "blob", known, "known")
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.coalesce("found", F.array().cast(f"array<{_SPAN}>")).alias(out))


def scan(docs: DataFrame, path: str | None = None, rules: tuple[Rules, ...] = ALL, text_col: str = "text", out: str = "spans", carry: list[str] | None = None) -> DataFrame:
    """Every row of docs with its findings, through the ledger at `path` or in the session's setting, else through one of its own."""
    spark = docs.sparkSession
    kept = path or spark.conf.get(SETTING, None)
    place = kept or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    found = findings(docs, update(docs, place, rules, text_col), text_col, out, carry)
    if not kept:
        delete(spark, place)
    return found


def redact(text, spans, mask: str = "[REDACTED]") -> F.Column:
    """The text with each span replaced by the mask; overlapping spans are merged."""
    start = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, start).otherwise(text)
