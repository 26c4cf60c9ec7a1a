"""Windows that occur at least twice in a corpus: the part common to both exact dedups.

1. Each partition sketches the anchor hashes of its runs; the sketches merge by cell into two
   bitmaps of cells counted twice or more (:func:`repeated_cells`).  An anchor's estimate is at
   least the count of any window of its run, so dropping anchors estimated at one drops no
   repeated window.
2. A second scan writes the runs that remain (:func:`candidate_runs`).
3. Runs that are equal as a whole repeat with all their windows (:func:`whole_runs`).  Of the
   anchors that several *different* runs share, one text per different run is cut out of its
   document (:func:`pieces`); the caller compares the windows of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runs import BYTE_SYMBOLS, Hasher, mix, runs
from ._shared import as_bytes, as_numpy, batch_of, materialise, signed, unsigned

#: log2 of the cells of one sketch row: two bitmaps of 16 MB are what is broadcast, at any input.
SKETCH_BITS = 27
SKETCH_ROWS = 2
BLOCK_BITS = 22
#: Classes of more different runs than this are compared by grouped window hashes in Spark.
CLASS_LIMIT = 4096
#: A run with over one in so many of the copied rows is looked up where its rows lie, not joined by key.
HOT_SHARE = 1000


def byte_symbols(body: np.ndarray) -> np.ndarray:
    return BYTE_SYMBOLS[body]


class _WordHashes(dict):
    """Word to 64-bit hash; refilled when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def forget_words() -> None:
    """Free the words' hashes at a task's end, as workers outlive their tasks."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def word_symbols(body: np.ndarray) -> np.ndarray:
    """A symbol per word; ``bytes.split`` parts at the six ASCII white-space characters."""
    words = body.tobytes().split()
    return mix(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))


Symbols = Callable[[np.ndarray], np.ndarray]


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(64 - bits * (row + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def repeated_cells(docs: DataFrame, symbols: Symbols, length: int, gram: int, bits: int = SKETCH_BITS) -> list:
    """Merged count-min sketch of anchor hashes, as one bitmap per row of cells counted >= 2.

    What reaches the driver is ``SKETCH_ROWS * 2**bits / 8`` bytes whatever the input.
    """
    spark, block_bits = docs.sparkSession, min(BLOCK_BITS, bits)
    sketch = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])
    merged = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("twice", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            for row in range(SKETCH_ROWS):
                cell, count = np.unique(_cells(keys, row, bits), return_counts=True)
                block = cell >> block_bits
                value = ((cell & ((1 << block_bits) - 1)) << 1 | (count > 1)).astype(np.uint32)
                ids, at = np.unique(block, return_index=True)
                parts = [x.tobytes() for x in np.split(value, at[1:])]
                yield batch_of(sketch, [[row] * len(ids), ids, parts])

        held, size = [], 0
        for batch in batches:
            for body in as_bytes(batch.column("body")):
                for _, hasher, _, _, anchor in runs(symbols(body), length, gram):
                    held.append(hasher.lane(0, anchor, anchor + gram))
                    size += len(anchor)
            if size > 2_000_000:
                yield from out(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from out(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[tuple, np.ndarray] = {}
        for batch in batches:
            rows, blocks = as_numpy(batch.column("row")), as_numpy(batch.column("block"))
            for row, block, value in zip(rows, blocks, as_bytes(batch.column("cells")), strict=True):
                value = np.frombuffer(value.tobytes(), np.uint32)
                count = once.setdefault((row, block), np.zeros(1 << block_bits, np.uint8))
                cell = value >> 1
                count[cell] = np.minimum(count[cell] + 1 + (value & 1).astype(np.uint8), 2)
        if once:
            yield batch_of(
                merged,
                [[k[0] for k in once], [k[1] for k in once], [np.packbits(v > 1).tobytes() for v in once.values()]],
            )

    found = (
        docs.select("body")
        .mapInArrow(partial, "row int, block int, cells binary")
        .repartition(SKETCH_ROWS << (bits - block_bits), "row", "block")
        .mapInArrow(merge, "row int, block int, twice binary")
    )
    maps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(SKETCH_ROWS)]
    each = (1 << block_bits) // 8
    for x in found.collect():
        maps[x.row][x.block * each : (x.block + 1) * each] = np.frombuffer(x.twice, np.uint8)
    return [spark.sparkContext.broadcast(m) for m in maps]


def candidate_runs(docs: DataFrame, symbols: Symbols, length: int, gram: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Runs ``kh, r1, r2, dkey, tkey, start, n`` whose anchor the sketch estimates at two or more.

    ``kh`` hashes the anchor, ``r1, r2`` the whole run with the anchor's place in it; ``start``
    is its first window's start and ``n`` its number of windows.
    """
    maps = repeated_cells(docs, symbols, length, gram, bits)
    names = ["kh", "r1", "r2", "dkey", "tkey", "start"]
    schema = pa.schema([(x, pa.int64()) for x in names] + [("n", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = [m.value for m in maps]
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in schema]
            keys = zip(as_numpy(batch.column("dkey")), as_numpy(batch.column("tkey")), strict=True)
            for (dkey, tkey), body in zip(keys, as_bytes(batch.column("body")), strict=True):
                for base, hasher, first, last, anchor in runs(symbols(body), length, gram):
                    kh = hasher.lane(0, anchor, anchor + gram)
                    keep = np.ones(len(kh), bool)
                    for row, bitmap in enumerate(twice):
                        cell = _cells(kh, row, bits)
                        keep &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                    first, last, anchor, kh = first[keep], last[keep], anchor[keep], kh[keep]
                    if not len(kh):
                        continue
                    place = ((anchor - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64)
                    tag = mix(place + np.uint64(1))
                    values = [
                        signed(kh),
                        signed(hasher.lane(0, first, last + length) ^ tag),
                        signed(hasher.lane(1, first, last + length) ^ tag),
                        np.full(len(kh), dkey), np.full(len(kh), tkey),
                        first + base, (last - first + 1).astype(np.int32),
                    ]
                    for part, value in zip(parts, values, strict=True):
                        part.append(value)
            if parts[0]:
                yield batch_of(schema, [np.concatenate(p) for p in parts])

    ddl = ", ".join(f"{x} long" for x in names) + ", n int"
    return materialise(docs.select("dkey", "tkey", "body").mapInArrow(cut, ddl), "runs")


def classes(candidates: DataFrame) -> DataFrame:
    """One row per different run of each anchor that two runs or more have."""
    different = candidates.groupBy("kh", "r1", "r2").agg(
        F.count("*").alias("copies"),
        *(F.first(x).alias(x) for x in ("dkey", "tkey", "start", "n")),
    )
    anchors = different.groupBy("kh").agg(
        F.sum("copies").alias("occurrences"), F.count("*").alias("different"), F.min("copies").alias("fewest")
    )
    return materialise(different.join(anchors.where("occurrences > 1"), "kh"), "classes")


def whole_runs(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Runs ``dkey, tkey, start, n`` that are repeated as a whole.

    A join by key would put all copies of one run in one task.  Fewer than ``HOT_SHARE`` runs can have
    over a ``HOT_SHARE``-th of the rows each, whatever the table's size, so those are broadcast.
    """
    run = ["kh", "r1", "r2"]
    copied = found.where("copies > 1")
    rows = copied.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > rows / HOT_SHARE
    often = F.broadcast(copied.where(hot).select(run))
    rest = candidates.join(often, run, "left_anti").join(copied.where(~hot).select(run), run, "left_semi")
    both = candidates.join(often, run, "left_semi").unionByName(rest)
    return both.select("dkey", "tkey", "start", F.col("n").cast("long").alias("n"))


def pieces(spread: DataFrame, found: DataFrame, symbols: Symbols, length: int, as_text: bool, hot: bool) -> DataFrame:
    """Different runs of mixed anchors that are ``hot`` or not, with what their windows are compared by.

    ``spread`` is the keyed documents partitioned by ``dkey, tkey``.  Returns ``kh, weight, dkey,
    tkey, start, n, data``: the run's bytes, or two hashes per window for hot anchors and where
    ``as_text`` is false.  ``weight`` is 2 for runs that have copies.
    """
    above = F.col("different") > CLASS_LIMIT
    wanted = found.where("fewest = 1 and different > 1").where(above if hot else ~above).select(
        "dkey", "tkey", F.struct("kh", "start", "n", F.least("copies", F.lit(2)).cast("int").alias("weight")).alias("run")
    )
    by_text = wanted.groupBy("dkey", "tkey").agg(F.collect_list("run").alias("runs"))
    schema = pa.schema([
        ("kh", pa.int64()), ("weight", pa.int32()), ("dkey", pa.int64()), ("tkey", pa.int64()),
        ("start", pa.int64()), ("n", pa.int32()), ("data", pa.binary()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys = zip(as_numpy(batch.column("dkey")), as_numpy(batch.column("tkey")), batch.column("runs"), strict=True)
            for (dkey, tkey, own), body in zip(keys, as_bytes(batch.column("body")), strict=True):
                hashed = None
                for run in own.as_py():
                    start, n = run["start"], run["n"]
                    if as_text and not hot:
                        data = body[start : start + n + length - 1].tobytes()
                    else:
                        hashed = symbols(body) if hashed is None else hashed
                        hasher = Hasher(hashed[start : start + n + length - 1])
                        at = np.arange(n)
                        data = np.concatenate([hasher.lane(0, at, at + length), hasher.lane(1, at, at + length)]).tobytes()
                    rows.append((run["kh"], run["weight"], dkey, tkey, start, n, data))
            if rows:
                yield batch_of(schema, list(zip(*rows, strict=True)))

    ddl = "kh long, weight int, dkey long, tkey long, start long, n int, data binary"
    # one text per key: rows with equal keys have equal texts, and lie in one sorted partition here
    texts = spread.join(by_text, ["dkey", "tkey"]).select("dkey", "tkey", "body", "runs").dropDuplicates(["dkey", "tkey"])
    return texts.mapInArrow(cut, ddl)


def by_anchor(parts: DataFrame, resolve: Callable, limit: int) -> DataFrame:
    """Run ``resolve(list of rows) -> list of (dkey, tkey, start, n)`` over bundles of whole anchors.

    A bundle closes once it holds ``limit`` bytes; an anchor has at most ``CLASS_LIMIT`` runs here.
    """
    schema = pa.schema([("dkey", pa.int64()), ("tkey", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle: list[tuple] = []
        size, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if found := resolve(bundle):
                yield batch_of(schema, list(zip(*found, strict=True)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= limit and row[0] != last:
                    yield from out()
                    bundle, size = [], 0
                bundle.append(row)
                size += len(row[-1])
                last = row[0]
        if bundle:
            yield from out()

    ordered = parts.repartition("kh").sortWithinPartitions("kh")
    return ordered.mapInArrow(run, "dkey long, tkey long, start long, n int")


def hot_windows(parts: DataFrame) -> DataFrame:
    """The exact way for anchors of very many different runs: count each window by its hashes."""
    names = ["w1", "w2", "dkey", "tkey", "start"]
    schema = pa.schema([(x, pa.int64()) for x in names] + [("weight", pa.int32())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for weight, dkey, tkey, start, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.frombuffer(data, np.int64)
                yield batch_of(schema, [w[:n], w[n:], np.full(n, dkey), np.full(n, tkey), start + np.arange(n), np.full(n, weight, np.int32)])

    windows = parts.select("weight", "dkey", "tkey", "start", "n", "data").mapInArrow(
        spell, ", ".join(f"{x} long" for x in names) + ", weight int"
    )
    counted = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("total")).where("total > 1")
    single = windows.where("weight = 1").join(counted, ["w1", "w2"], "left_semi")
    return single.select("dkey", "tkey", "start", F.lit(1).alias("n"))


def consecutive(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted integers as maximal runs: starts and lengths."""
    at = np.flatnonzero(np.concatenate(([True], np.diff(first) != 1)))
    return first[at], np.diff(np.append(at, len(first)))


def repeats_by_text(docs: DataFrame, symbols: Symbols, length: int, gram: int, resolve: Callable, as_text: bool, limit: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Keyed documents with ``repeats``: ``struct(start, n)`` of repeated windows' starts, or null."""
    candidates = candidate_runs(docs, symbols, length, gram, bits)
    found = classes(candidates)
    spread = docs.repartition("dkey", "tkey")
    cut = lambda hot: pieces(spread, found, symbols, length, as_text, hot)
    ranges = whole_runs(candidates, found).unionByName(by_anchor(cut(False), resolve, limit))
    if not found.where(F.col("different") > CLASS_LIMIT).isEmpty():
        ranges = ranges.unionByName(hot_windows(cut(True)))
    by_text = joined_ranges(ranges).groupBy("dkey", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("repeats"))
    return spread.join(by_text, ["dkey", "tkey"], "left")


def joined_ranges(ranges: DataFrame) -> DataFrame:
    """Each text's ranges of starts ``dkey, tkey, start, n`` with those joined that touch or overlap.

    Repeated rows give equal ranges and one letter's text gives one for each run; both come out as
    few, so what is collected for a text is bounded by what it has apart.
    """
    text = Window.partitionBy("dkey", "tkey").orderBy("start")
    end = F.col("start") + F.col("n")
    apart = F.col("start") > F.max(end).over(text.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("apart").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("dkey", "tkey", "island").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("n"))
    return islands.select("dkey", "tkey", "start", "n")


def hashed_windows(rows: list[tuple]) -> list[tuple]:
    """Group a bundle's windows by both hashes; those of single runs that occur again."""
    n = np.array([r[5] for r in rows])
    piece = np.repeat(np.arange(len(rows)), n)
    data = [np.frombuffer(r[6], np.uint64) for r in rows]
    w1, w2 = (np.concatenate([d[i * k : (i + 1) * k] for d, k in zip(data, n, strict=True)]) for i in (0, 1))
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    weight = np.array([r[1] for r in rows])[piece]
    again = np.empty(len(order), bool)
    again[order] = np.repeat(np.add.reduceat(weight[order], head) > 1, np.diff(np.append(head, len(order))))
    return ranges_of(rows, piece, np.concatenate([np.arange(k) for k in n]), again & (weight == 1))


def ranges_of(rows: list[tuple], piece: np.ndarray, offset: np.ndarray, flag: np.ndarray) -> list[tuple]:
    """Flagged window starts (in order of piece and offset) as ranges of their documents."""
    out, piece, offset = [], piece[flag].astype(np.int64), offset[flag]
    at, size = consecutive(piece * (1 << 40) + offset)
    for x, n in zip(at, size, strict=True):
        row = rows[x >> 40]
        out.append((row[2], row[3], row[4] + (x & ((1 << 40) - 1)), n))
    return out


__all__ = ["byte_symbols", "hashed_windows", "ranges_of", "repeats_by_text", "unsigned", "word_symbols"]
