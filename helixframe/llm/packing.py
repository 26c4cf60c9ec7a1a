"""Sequence packing by bounded-space online best fit.

Each scan partition packs its own documents as they come: ``open_bins`` sequences are open, a
bitset has the free spaces among them, and a piece goes where the least space is left over.  If
none has room, a new sequence is opened, and beyond the bound the fullest one closes.  Nothing is
shuffled or gathered, and a partition that is computed again gives the same sequences.

Nulls count as empty texts, which are the end id alone; texts longer than a sequence are cut so
that only their first piece may be short; repeated rows are packed each; an empty table gives an
empty result; columns other than doc_id, text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, slices, small_batches
from ._tokens import default_path, encoder

CAPACITY = 2048
OPEN_BINS = 1024
END_ID = 0


class OpenBins:
    """Open sequences by free space; ``spaces`` has bit *f* set if some bin has *f* left."""

    def __init__(self, capacity: int, bound: int, first_id: int):
        self.capacity, self.bound, self.next_id = capacity, bound, first_id
        self.spaces, self.bins, self.count = 0, {}, 0

    def _take(self, free: int) -> int:
        own = self.bins[free]
        found = own.pop()
        if not own:
            self.spaces ^= 1 << free
        self.count -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and place in it for a piece of ``size`` tokens."""
        fitting = self.spaces >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count >= self.bound:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            free, sequence = self.capacity, self.next_id
            self.next_id += 1
        if left := free - size:
            self.bins.setdefault(left, []).append(sequence)
            self.spaces |= 1 << left
            self.count += 1
        return sequence, self.capacity - free


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids binary, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers.
    """
    path = tokenizer or default_path()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"), end_id), strict=True):
                    for piece, (start, n) in enumerate(cuts(len(ids), capacity)):
                        sequence, offset = bins.place(n)
                        rows.append((doc_id, piece, start, n, ids[start : start + n].astype("<u4").tobytes(), sequence, offset))
                yield batch_of(schema, list(zip(*rows, strict=True)))

    ddl = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
