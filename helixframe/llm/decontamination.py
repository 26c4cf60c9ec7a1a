"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a *segment* is a bounded run of one scan partition's texts,
and holds, for each of its terms, the ascending list of places where it occurs (places count words
from the segment's start, with a gap between texts, so no phrase crosses two).  It is stored as a
table, one row a term and segment.

A benchmark window is looked up segment by segment.  Windows are listed under the term of theirs
that fewest windows have, so only those under a term that a segment holds are considered, and of
these those whose every term it holds.  Then terms are taken from the rarest in that segment on, and
each list, moved back by the term's offset in the window, is intersected with the candidates so far.
What is left are the exact places of the phrase.  ``slop`` also reports places where the two rarest
terms stand within that many words of their offsets (proximity matches).

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text, dealt by item; each block's windows
are broadcast, looked up in the one index, and let go before the next block is read.  Their matches
are tables, which are put together by document at the end.

Words are lower-cased in A-Z and cut at ASCII characters that are no letters or digits.  Null
texts and items have no words and match nothing; an item shorter than a window is one window;
equal windows of several items count for each; repeated rows are judged each; empty tables give
empty or unhit results; other columns are ignored.  Segments are bounded, so a hot term or a group
of copies spreads over as many segments as its texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, batch_of, cover, materialise, small_batches
from .toxicity import words_of

WINDOW = 10
SEGMENT_WORDS = 1 << 21
#: Bytes of benchmark text whose windows are sent to every task at once.
BLOCK_BYTES = 8 << 20
INDEX = "segment long, term binary, n int, places binary"


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """Segments of ``docs``: postings, and under a null term each segment's documents.

    ``places`` are little-endian integers: differences of 32 bits between a term's places, or the
    64-bit triples (doc_id, whether it is null, first place) of the documents, with the end last.
    """
    schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        terms: dict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__
        ids, docs_, place = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            term = np.concatenate([x for x, _ in ids]) if ids else np.zeros(0, np.int32)
            at = np.concatenate([np.arange(p, p + len(x), dtype=np.int32) for x, p in ids]) if ids else term
            order = np.argsort(term, kind="stable")
            count = np.bincount(term, minlength=len(terms))
            places = at[order]
            delta = np.diff(places, prepend=0).astype("<i4")
            start = np.cumsum(count) - count
            delta[start] = places[start]
            cut, edge = delta.tobytes(), [*(4 * start).tolist(), 4 * len(delta)]
            table = np.array([(d or 0, d is None, p) for d, p in docs_] + [(0, 0, place)], "<i8").tobytes()
            names = [*terms, None]
            lists = [cut[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)] + [table]
            for i in range(0, len(names), 20_000):
                n = [*count.tolist(), len(docs_)][i : i + 20_000]
                yield batch_of(schema, [np.full(len(n), number), names[i : i + 20_000], n, lists[i : i + 20_000]])

        for batch in batches:
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("body")), strict=True):
                words = words_of(body.tobytes())
                docs_.append((doc_id, place))
                if words:
                    ids.append((np.fromiter(map(terms.__getitem__, words), np.int32, len(words)), place))
                place += len(words) + gap
                if place >= SEGMENT_WORDS:
                    yield from close()
                    number, place = number + 1, 0
                    terms.clear()
                    ids, docs_ = [], []
        if docs_:
            yield from close()

    bodies = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return materialise(bodies.mapInArrow(run, INDEX), "postings")


def windows_of(body: bytes, window: int) -> list[tuple[bytes, ...]]:
    words = words_of(body)
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def phrase_places(window: tuple[int, ...], lists: list[np.ndarray], slop: int = 0) -> np.ndarray:
    """Places where the terms of ``window`` stand in a row; with ``slop``, near their offsets."""
    order = sorted(range(len(window)), key=lambda i: (len(lists[window[i]]), i))
    found = lists[window[order[0]]] - order[0]
    for offset in order[1:] if not slop else order[1:2]:
        if not len(found):
            break
        own = lists[window[offset]]
        at = np.searchsorted(own, found + offset - slop)
        hit = at < len(own)
        hit[hit] = own[at[hit]] <= found[hit] + offset + slop
        found = found[hit]
    return found


class Phrases:
    """Different windows of some items: their terms, owners, and a list of windows for each term."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        owners: dict[tuple, set] = defaultdict(set)
        for item, body in items:
            for own in windows_of(body, window):
                owners[own].add(item)
        self.terms = {t: i for i, t in enumerate(sorted({t for own in owners for t in own}))}
        self.owners = [sorted(x, key=str) for x in owners.values()]
        self.size = np.fromiter(map(len, owners), np.int32, len(owners))
        self.term = np.fromiter((self.terms[t] for own in owners for t in own), np.int32, int(self.size.sum()))
        self.start = np.cumsum(self.size) - self.size
        used = np.bincount(self.term, minlength=len(self.terms))
        least = [int(min(self.phrase(i), key=lambda t: (used[t], t))) for i in range(len(self.size))]
        self.under = np.argsort(least, kind="stable")
        self.under_start = np.searchsorted(np.sort(least), np.arange(len(self.terms) + 1))

    def phrase(self, i: int) -> np.ndarray:
        return self.term[self.start[i] : self.start[i] + self.size[i]]

    def possible(self, held: np.ndarray) -> list[int]:
        """Windows whose every term is among the sorted terms ``held``."""
        found = [self.under[self.under_start[t] : self.under_start[t + 1]] for t in held]
        listed = np.concatenate([np.zeros(0, np.int64), *found])
        has = np.zeros(len(self.terms), bool)
        has[held] = True
        return [i for i in listed.tolist() if has[self.phrase(i)].all()]


def _blocks(texts: DataFrame, size: int) -> list[DataFrame]:
    """The benchmark's items in parts of about ``size`` bytes."""
    total = texts.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    return [texts.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n)) == block) for block in range(n)] if n > 1 else [texts]


def _look_up(index: DataFrame, items: DataFrame, window: int, slop: int) -> tuple[DataFrame, Broadcast]:
    """``segment, place, doc_id, n_words, hits, items, near`` of every document in the index, and what was sent for it."""
    spark = index.sparkSession
    phrases = Phrases([(r.item_id, bytes(r.body)) for r in items.collect()], window)  # a block of items
    shared = spark.sparkContext.broadcast(phrases)
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("hits", pa.list_(struct)), ("items", pa.list_(pa.int64())), ("near", pa.list_(pa.int64())),
    ])

    def search(segment: int, postings: dict[int, np.ndarray], table: np.ndarray) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        lists = {k: np.cumsum(v, dtype=np.int64) for k, v in postings.items()}
        first, n_docs = table[:, 2], len(table) - 1
        hits: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        near: dict[int, set] = defaultdict(set)
        for i in phrases.possible(np.array(sorted(lists), np.int64)):
            phrase, owner = phrases.phrase(i).tolist(), phrases.owners[i]
            for into, places in ((items, phrase_places(phrase, lists)), *([(near, phrase_places(phrase, lists, slop))] if slop else [])):
                at = np.searchsorted(first, places, "right") - 1
                for doc, place in zip(at.tolist(), places.tolist(), strict=True):
                    if 0 <= doc < n_docs:
                        into[doc].update(owner)
                        if into is items:
                            hits[doc].append((place - first[doc], place - first[doc] + len(phrase)))
        size = np.diff(first) - window
        spans = []
        for doc in range(n_docs):
            own = np.array(sorted(hits[doc]), np.int64).reshape(-1, 2) if doc in hits else None
            a, b = cover(own[:, 0], own[:, 1], int(size[doc])) if own is not None else ((), ())
            spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
        ids = [None if null else d for d, null, _ in table[:-1].tolist()]
        of = [[sorted(x[d]) if d in x else [] for d in range(n_docs)] for x in (items, near)]
        yield batch_of(schema, [np.full(n_docs, segment), first[:-1], ids, size, spans, *of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, current, postings, table = shared.value.terms, None, {}, None
        for batch in batches:
            for segment, term, places in zip(batch.column("segment").to_pylist(), batch.column("term").to_pylist(), batch.column("places"), strict=True):
                if segment != current:
                    if table is not None:
                        yield from search(current, postings, table)
                    current, postings, table = segment, {}, None
                if term is None:
                    table = np.frombuffer(places.as_py(), "<i8").reshape(-1, 3)
                else:
                    postings[known[term]] = np.frombuffer(places.as_py(), "<i4")
        if table is not None:
            yield from search(current, postings, table)

    wanted = spark.createDataFrame([(bytearray(t),) for t in phrases.terms], "term binary")
    lists = index.where("term is not null").join(F.broadcast(wanted), "term", "left_semi").select("segment", "term", "places")
    own = lists.unionByName(index.where("term is null").select("segment", "term", "places"))
    return own.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, f"segment long, place long, {FOUND}"), shared


FOUND = "doc_id long, n_words long, hits array<struct<start: long, end: long>>, items array<long>, near array<long>"


def _together(found: DataFrame) -> DataFrame:
    """One row a document of several blocks' matches."""
    kinds = found.select("doc_id", "n_words", "hits", "items", "near").schema
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near")]  # a list for each block
    merged = found.groupBy("segment", "place").agg(F.first("doc_id", True).alias("doc_id"), F.first("n_words").alias("n_words"), *lists)
    items = F.array_sort(F.array_distinct("items"))
    near = F.array_sort(F.array_except(F.array_distinct("near"), "items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own, n in zip(batch.column("hits").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                a, b = cover(np.array([x["start"] for x in own], np.int64), np.array([x["end"] for x in own], np.int64), n) if own else ((), ())
                spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
            i = batch.schema.get_field_index("hits")
            yield batch.set_column(i, batch.schema.field(i), pa.array(spans, batch.schema.field(i).type))

    return merged.select("doc_id", "n_words", "hits", items.alias("items"), near.alias("near")).mapInArrow(join, kinds)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``doc_id, n_words, hits array<struct<start, end>>, items array<long>, near array<long>``.

    ``hits`` are maximal runs of covered words; ``items`` have exact windows in the document,
    ``near`` those that only match by proximity (empty without ``slop``).
    """
    texts = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("body"))
    index = build_index(docs, window)
    blocks = _blocks(texts, BLOCK_BYTES)
    if len(blocks) == 1:
        one, _ = _look_up(index, blocks[0], window, slop)
    else:  # one block at a time to a table, and what was sent for it is let go: the driver holds one
        found = []
        for i, items in enumerate(blocks):
            part, sent = _look_up(index, items, window, slop)
            hit = (F.size("hits") > 0) | (F.size("near") > 0)
            found.append(materialise(part.where(hit) if i else part, "block"))  # the first has every document
            sent.destroy()
        one = _together(reduce(DataFrame.unionByName, found))
    tidy = F.array_except("near", "items")
    return one.select("doc_id", "n_words", "hits", "items", tidy.alias("near"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
