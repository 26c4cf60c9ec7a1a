"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one of our own only where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches bounded by bytes, as texts may be very long."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder."""
    path = new_table_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``dkey, tkey`` name a document's text: rows with equal keys have equal texts.

    Null ids and null texts get the keys of 0 and of the empty text; both are harmless, as
    ``tkey`` hashes the text, and what is joined back depends on the text alone.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    return small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("dkey"),
        F.xxhash64(body).alias("tkey"),
        body.cast("binary").alias("body"),
        *more,
    )


def as_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """Each value of a binary column as a view of its bytes."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]]


def slices(batch: pa.RecordBatch, column: str, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows; one closes once its texts hold ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        full = np.searchsorted(ends, (ends[at - 1] if at else 0) + size) + 1
        n = min(rows, batch.num_rows - at, int(full) - at)
        yield batch.slice(at, n)
        at += n


def as_numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int64).view(np.uint64)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, clipped to ``n``: maximal runs' starts and ends."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(ends, n), -1)
    inside = np.concatenate(([0], (np.cumsum(step[:n]) > 0).astype(np.int8), [0]))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
