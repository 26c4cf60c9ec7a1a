"""Token ids in ORC files, in ascending document order.

Documents are dealt by ranges of doc_id and sorted within them, so file order is document order.
ids are written as a list of integers, which ORC run-length encodes in stripes; row indexes and a
Bloom filter on doc_id let readers skip stripes, and stripes are read in parallel.

:func:`find_documents` reads the documents of a few ids through these indexes.

Nulls count as empty texts, which are the end id alone; a null doc_id comes first; rows of equal
doc_id are ordered by their texts' hash, and may lie in several files; an empty table gives an empty result; columns other than
doc_id, text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import batch_of, materialise, new_table_path, slices, small_batches
from ._tokens import default_path, encoder

END_ID = 2
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}
SCHEMA = "part int, row long, doc_id long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write ``part, row, doc_id, ids`` as ORC: ``part`` numbers the files in document order."""
    vocabulary = tokenizer or default_path()
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = encoder(vocabulary).encode_flat, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, start = encode(batch.column("text"), end_id)
                lists = pa.ListArray.from_arrays(start.astype(np.int32), pa.array(ids.view(np.int32)))
                n = batch.num_rows
                yield batch_of(schema, [np.full(n, part, np.int32), np.arange(row, row + n), batch.column("doc_id"), lists])
                row += n

    ordered = (
        small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(run, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def find_documents(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of the given documents.

    The filter reaches the scan, which skips stripes by their statistics and Bloom filters, and
    groups of ``orc.row.index.stride`` rows by the row index.
    """
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_index(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what :func:`read_tokens` gives.

    ``start`` counts the ids of all documents before: a sum within each file, plus the totals of
    the files before it, of which there is one row a file.
    """
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield batch_of(schema, [*(batch.column(x) for x in ("part", "row", "doc_id")), np.diff(offsets).astype(np.int64), crc])

    # read once; what is kept of a document is a row of five numbers
    measured = materialise(tokens.mapInArrow(run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"), "measured")
    before = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    within = measured.withColumn("within", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = measured.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return within.join(bases, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_index(read_tokens(spark, path))
