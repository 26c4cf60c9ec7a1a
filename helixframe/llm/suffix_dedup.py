"""Exact substring dedup over bytes, by merged Burrows-Wheeler transforms.

Only regions that can hold a repeat are indexed: runs of windows whose anchor occurs again (see
``_repeats``).  Bundles of such regions are cut into shards.  Each shard orders its suffixes and
keeps its transform: for every suffix, in order, the symbol before it.  Symbols are whole
substrings of ``stride`` bytes, and each region is read as a circle, so that stepping back
permutes its positions (an extended, multi-string transform).

Shards merge by iterative interleave refinement: a vector names the shard of each suffix in
merged order.  Round *t* sends it through the transforms with one stable bucketing by symbol,
after which it is the interleave of suffixes ordered by *t* symbols.  No suffix is compared or
sorted again.  Boundaries that appear in round *t* are those of common prefixes of *t - 1*
symbols, so intervals without a boundary after ``length / stride`` rounds are the repeated
windows.

Nulls count as empty texts; texts shorter than a window lose nothing; repeated rows are separate
occurrences; an empty table gives an empty result; columns other than doc_id, text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as R
from ._runs import BYTE_SYMBOLS, Hasher
from ._shared import as_bytes, batch_of, cover, keyed

LENGTH = 400
GRAM = 200
STRIDE = 100
SHARDS = 2
BUNDLE_BYTES = 1 << 20
#: Texts are hashed in slices of about this many bytes, which bounds the hasher's tables.
SLICE_BYTES = 1 << 18


def _stable_order(symbol: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit symbols by two bucketings of 16 bits."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((symbol[order] >> 16).astype(np.uint16), kind="stable")]


@dataclass
class ShardTransform:
    """Suffix order of one shard (positions in the bundle) and the symbol before each suffix."""

    order: np.ndarray
    before: np.ndarray


def shard_transform(positions: np.ndarray, symbol: np.ndarray, back: np.ndarray, rounds: int) -> ShardTransform:
    """Order a shard's suffixes by ``rounds`` symbols, prepending one symbol a round."""
    order = positions
    for _ in range(rounds):
        order = back[order]
        order = order[_stable_order(symbol[order])]
    return ShardTransform(order, symbol[back[order]])


def merge_transforms(shards: list[ShardTransform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes, and the common prefix with the suffix before, in symbols.

    The prefix length is exact below ``rounds`` and ``rounds`` stands for that or more.
    """
    before = np.concatenate([s.before for s in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    n = len(before)
    prefix = np.full(n, rounds, np.int32)
    prefix[:1] = 0
    block = np.zeros(n, np.int32)
    symbol = np.empty_like(before)
    for depth in range(rounds):
        symbol[np.argsort(interleave, kind="stable")] = before
        move = _stable_order(symbol)
        interleave, ordered, block = interleave[move], symbol[move], block[move]
        edge = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (block[1:] != block[:-1])))
        block = np.cumsum(edge, dtype=np.int32)
        prefix[edge & (prefix == rounds)] = depth
        prefix[:1] = 0
    return interleave, prefix


def circle_grams(texts: list[bytes], stride: int) -> np.ndarray:
    """Hash of the ``stride`` bytes from every place of every text, read as a circle."""
    ends = np.cumsum([len(t) for t in texts])
    out, at = [], 0
    while at < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)) + 1
        own, at = texts[at:upto], upto
        sizes = np.array([len(t) for t in own])
        hasher = Hasher(BYTE_SYMBOLS[np.frombuffer(b"".join(t + t[:stride] for t in own), np.uint8)])
        start = np.arange(sizes.sum()) + np.repeat(np.arange(len(own)) * stride, sizes)
        out.append(hasher.lane(0, start, start + stride))
    return np.concatenate(out)


def repeated_windows(texts: list[bytes], weights: np.ndarray, windows: np.ndarray, length: int = LENGTH, stride: int = STRIDE, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position of the bundle: its text, its offset, and whether its window repeats.

    Windows start at the first ``windows[i]`` offsets of text ``i``; a text of weight 2 stands
    for two or more equal ones.
    """
    rounds = length // stride
    symbol = np.unique(circle_grams(texts, stride), return_inverse=True)[1].astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int32)
    piece = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    offset = np.arange(len(piece), dtype=np.int32) - starts[piece]
    back = starts[piece] + (offset - np.int32(stride)) % sizes[piece]
    cuts = np.searchsorted(starts, len(piece) * np.arange(1, shards) / shards)
    bounds = [0, *np.append(starts, len(piece))[cuts], len(piece)]
    built = [
        shard_transform(np.arange(a, b, dtype=np.int32), symbol, back, rounds) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a
    ]
    interleave, prefix = merge_transforms(built, rounds)
    merged = np.empty(len(piece), np.int32)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate([s.order for s in built])
    head = np.flatnonzero(prefix < rounds)
    weight = np.where(offset < windows[piece], weights[piece], 0)
    again = np.empty(len(piece), bool)
    again[merged] = np.repeat(np.add.reduceat(weight[merged], head) > 1, np.diff(np.append(head, len(merged))))
    return piece, offset, again & (weight == 1)


def _resolver(length: int, stride: int, shards: int):
    def resolve(rows: list[tuple]) -> list[tuple]:
        texts = [r[6] for r in rows]
        weights, windows = np.array([r[1] for r in rows]), np.array([r[5] for r in rows])
        return R.ranges_of(rows, *repeated_windows(texts, weights, windows, length, stride, shards))

    return resolve


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, stride: int = STRIDE, shards: int = SHARDS, bits: int = R.SKETCH_BITS) -> DataFrame:
    """Cut out every byte that a repeated ``length``-byte string covers.

    Returns ``doc_id, kept binary, n_bytes, spans array<struct<start, end>>``: what remains and
    the maximal removed runs.  ``stride`` must divide ``length``; ``gram < length``.
    """
    if length % stride or not 0 < gram < length:
        raise ValueError("stride must divide length, and gram must be less than length")
    found = R.repeats_by_text(
        keyed(docs), R.byte_symbols, length, gram, _resolver(length, stride, shards), True, BUNDLE_BYTES, bits
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, spans = [], [], []
            for own, body in zip(batch.column("repeats").to_pylist(), as_bytes(batch.column("body")), strict=True):
                sizes.append(len(body))
                if not own:
                    kept.append(body.tobytes())
                    spans.append([])
                    continue
                start = np.array([x["start"] for x in own])
                n = np.array([x["n"] for x in own])
                a, b = cover(start, start + n + length - 1, len(body))
                keep = np.ones(len(body), bool)
                for x, y in zip(a, b, strict=True):
                    keep[x:y] = False
                kept.append(body[keep].tobytes())
                spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
            yield batch_of(schema, [batch.column("doc_id"), kept, sizes, spans])

    ddl = "doc_id long, kept binary, n_bytes long, spans array<struct<start: long, end: long>>"
    return found.select("doc_id", "body", "repeats").mapInArrow(cut, ddl)


def digest(removed: DataFrame) -> DataFrame:
    return removed.selectExpr(
        "doc_id", "n_bytes", "n_bytes - length(kept) as n_removed", "cast(size(spans) as long) as n_spans",
        "sha2(kept, 256) as kept_sha256",
    )


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


__all__ = ["digest", "merge_transforms", "remove_repeats", "repeated_windows", "shard_transform"]
