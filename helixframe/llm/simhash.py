"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint bit is set if it is set in more than half of the shingle hashes.  Pairs within the
radius are found without loss: bit *i* gets a vector ``m(i)`` of ``radius + 1`` bits, and for each
non-zero vector *v* one table keys fingerprints by the bits with ``<m(i), v> = 1``.  At most
``radius`` differing bits leave some *v* orthogonal to all their vectors, so the pair agrees on
that table's whole mask.

Only different fingerprints enter the tables.  A bucket returns a spanning forest of its links,
never all pairs; a bucket above ``BUCKET`` is keyed again by masks of another assignment, up to
``LEVELS`` times, after which the bits left free bound its size.

Nulls and texts without words have fingerprint zero; ties and repeated rows share a fingerprint;
an empty table gives an empty result; columns other than doc_id, text are ignored.  Rows whose
doc_id is null take part and get their component's least id, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import as_bytes, as_numpy, batch_of, materialise, small_batches

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 1024
LEVELS = 4
CHUNK = 1 << 16


def shingle_hashes(body: bytes, words_each: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of A-Z-lowered words, in chunks."""
    words = body.lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_each, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        a, b = starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist()
        yield np.fromiter((digest(line[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a))


def fingerprint(body: bytes, words_each: int) -> int:
    count, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(body, words_each):
        n += len(h)
        count += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(b.tobytes(), words_each) for b in as_bytes(batch.column("body"))]
            yield batch_of(schema, [batch.column("doc_id"), np.array(fps, np.uint64).view(np.int64)])

    bodies = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return bodies.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """``2**(radius + 1) - 1`` masks; bits are dealt evenly over the non-zero vectors."""
    vectors = (1 << (radius + 1)) - 1
    dealt = np.random.default_rng(1 + level).permutation(BITS) % vectors + 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(BITS) if bin(int(dealt[i]) & v).count("1") & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links within one bucket: members and their tree's first member."""
    left = np.sort(fps)
    nodes: list[int] = []
    roots: list[int] = []
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for part in np.array_split(frontier, len(frontier) * len(left) // 4_000_000 + 1):
                near |= (np.bitwise_count(part[:, None] ^ left[None, :]) <= radius).any(0)
            frontier, left = left[near], left[~near]
            nodes += frontier.tolist()
            roots += [int(root)] * len(frontier)
    return nodes, roots


def _bucket_links(keyed: DataFrame, radius: int, last: bool) -> DataFrame:
    """``a, b, late``: links, and (bucket, fingerprint) of buckets that are too large."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("late", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, spilt = None, [np.zeros(0, np.uint64)], False

        def close() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held)
            if spilt:
                yield batch_of(schema, [np.full(len(fps), held_key), fps.view(np.int64), np.ones(len(fps), bool)])
            elif len(fps) > 1:
                nodes, roots = _forest(fps, radius)
                if nodes:
                    pair = [np.array(x, np.uint64).view(np.int64) for x in (nodes, roots)]
                    yield batch_of(schema, [*pair, np.zeros(len(nodes), bool)])

        for batch in batches:
            key, fp = as_numpy(batch.column("bucket")), as_numpy(batch.column("fp")).view(np.uint64)
            if not len(key):
                continue
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(head, len(key)))
            # a batch's first bucket may go on from the one before, its last into the next
            if key[0] != held_key:
                yield from close()
                held_key, held, spilt = key[0], [], False
            held.append(fp[: size[0]])
            if not last and (spilt or sum(map(len, held)) > BUCKET):
                spilt = True
                yield from close()
                held = [np.zeros(0, np.uint64)]
            if len(head) == 1:
                continue
            yield from close()
            inner, inner_size = head[1:-1], size[1:-1]
            two = inner[inner_size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            if len(two):
                yield batch_of(schema, [fp[two].view(np.int64), fp[two + 1].view(np.int64), np.zeros(len(two), bool)])
            for at, n in zip(inner[inner_size > 2], inner_size[inner_size > 2], strict=True):
                held_key, held, spilt = key[at], [fp[at : at + n]], not last and n > BUCKET
                yield from close()
            held_key, held, spilt = key[head[-1]], [fp[head[-1] :]], False
        yield from close()

    ordered = keyed.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "a long, b long, late boolean")


def covering_links(different: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: links that join all of ``different (fp)`` within the radius, and none beyond it."""
    links, rows = None, different.select("fp", F.lit(0).cast("long").alias("of"))
    for level in range(LEVELS):
        masks = covering_masks(radius, level)
        tables = F.explode(F.array(*(F.xxhash64("of", F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks))))
        found = materialise(_bucket_links(rows.select("fp", tables.alias("bucket")), radius, level == LEVELS - 1), "links")
        own = found.where("not late").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = own if links is None else links.unionByName(own)
        rows = found.where("late").select(F.col("b").alias("fp"), F.col("a").alias("of"))
        if rows.isEmpty():
            break
    return links


def components(docs: DataFrame, words_each: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: documents linked through fingerprints within the radius."""
    marked = materialise(fingerprints(docs, words_each), "fingerprints")
    different = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(covering_links(different, radius)).withColumnRenamed("u", "fp")
    rooted = different.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
