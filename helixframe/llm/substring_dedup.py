"""Exact dedup of word windows behind a count-min prefilter.

First pass: every partition sketches its windows and the sketches are added cell by cell.  A
window is sketched under its anchor, the smallest of its 8-word grams, once per run of windows
that share it, so a cell's count is never below the count of any of its windows.  Second pass:
windows whose every cell counts less than two are unique and dropped; all others are grouped
exactly, whole runs first, then single windows of runs that differ.

Nulls have no words; documents shorter than a window lose nothing; repeated rows are separate
occurrences; an empty table gives an empty result; columns other than doc_id, text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as R
from ._shared import as_bytes, batch_of, cover, keyed

WINDOW = 35
GRAM = 8
BUNDLE_BYTES = 1 << 22


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = R.SKETCH_BITS) -> DataFrame:
    """Drop every word that a repeated window of ``window`` words covers.

    Returns ``doc_id, kept string, n_words, spans array<struct<start, end>>`` (word places).
    """
    if not 0 < gram < window:
        raise ValueError("gram must be less than window")
    found = R.repeats_by_text(keyed(docs), R.word_symbols, window, gram, R.hashed_windows, False, BUNDLE_BYTES, bits)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, spans = [], [], []
            for own, body in zip(batch.column("repeats").to_pylist(), as_bytes(batch.column("body")), strict=True):
                words = body.tobytes().split()
                sizes.append(len(words))
                removed = []
                if own:
                    start, n = np.array([x["start"] for x in own]), np.array([x["n"] for x in own])
                    a, b = cover(start, start + n + window - 1, len(words))
                    removed = [{"start": x, "end": y} for x, y in zip(a, b, strict=True)]
                    edges = np.concatenate(([0], np.column_stack([a, b]).ravel(), [len(words)]))
                    words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                kept.append(b" ".join(words).decode())
                spans.append(removed)
            yield batch_of(schema, [batch.column("doc_id"), kept, sizes, spans])

    ddl = "doc_id long, kept string, n_words long, spans array<struct<start: long, end: long>>"
    return found.select("doc_id", "body", "repeats").mapInArrow(cut, ddl)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
