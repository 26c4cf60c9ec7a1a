"""Secret scans over an incremental blob ledger.

Every version of every text is named by its SHA-256.  The ledger, a Parquet table, holds the
findings of each (blob, rule version) that was ever scanned.  A run scans the blobs that the
ledger lacks for the present rules, each once however many paths carry it, appends them, and
joins findings back to all paths.  A second run over the same texts scans nothing; changed rules
have a new version and scan all again.

Null texts count as empty; repeated rows and copies share one blob; empty texts have no findings;
an empty table gives an empty result; columns other than doc_id, text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, new_table_path, small_batches

#: (kind, pattern, group whose length counts, least length).  The first three are the base kinds.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
BASE = ("assign", "access", "hex")
_RUN = re.compile(r"[A-Za-z0-9_-]+")
LEDGER = "blob string, rules string, spans array<struct<kind: string, start: long, end: long>>"


def rules_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def dotted_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the ``jwt`` rule's matches, in time linear in the text.

    Its segments hold no dot, so each but the first is a whole run of its letters.  Of a run's places
    that may start a match, the first does if any does; so a run is looked at once in each of the
    three places that it can have.
    """
    at = 0
    while (start := text.find("eyJ", at)) >= 0:
        first = _RUN.match(text, start).end()
        at = first
        if first - start < 11 or not text.startswith(".eyJ", first):
            continue
        second = _RUN.match(text, first + 1).end()
        if second - first < 12 or not text.startswith(".", second):
            continue
        third = _RUN.match(text, second + 1)
        if third and third.end() - second > 8:
            at = third.end()
            yield start, at


def _finder(pattern: str, group: int, least: int):
    if pattern == dict((r[0], r[1]) for r in RULES)["jwt"]:
        return dotted_tokens
    compiled = re.compile(pattern, re.ASCII)
    return lambda text: ((m.start(), m.end()) for m in compiled.finditer(text) if m.end(group) - m.start(group) >= least)


def find(text: str, finders) -> list[dict]:
    """Leftmost non-overlapping matches of each rule, by start and then by the rules' order."""
    found = []
    for place, (kind, spans) in enumerate(finders):
        found += [(start, place, end, kind) for start, end in spans(text)]
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(found)]


def new_ledger(spark, path: str | None = None) -> str:
    path = path or new_table_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return path


def scan_unseen(docs: DataFrame, ledger: str, rules=RULES) -> None:
    """Scan blobs of ``docs (text)`` that the ledger lacks under these rules, and append them."""
    spark, version = docs.sparkSession, rules_version(rules)
    text = F.coalesce("text", F.lit(""))
    # copies within a task meet before the shuffle, so a hot blob sends one text a task
    blobs = small_batches(docs).select(F.sha2(text, 256).alias("blob"), text.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == version).select("blob")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("blob", pa.string()), ("rules", pa.string()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(kind, _finder(p, group, least)) for kind, p, group, least in rules]
        for batch in batches:
            spans = [find(t, finders) for t in batch.column("body").to_pylist()]
            yield batch_of(schema, [batch.column("blob"), [version] * len(spans), spans])

    blobs.join(seen, "blob", "left_anti").mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules=RULES, *keep: str) -> DataFrame:
    """``doc_id, blob, spans`` and the columns of ``keep`` for every row of ``docs``."""
    known = docs.sparkSession.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == rules_version(rules))
    paths = docs.select(F.col("doc_id"), *keep, F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    return paths.join(known.select("blob", "spans"), "blob")


def _spelled(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = new_ledger(spark)
    scan_unseen(docs, ledger)
    found = findings(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(count(k) for k in BASE),
        F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"),
    )
