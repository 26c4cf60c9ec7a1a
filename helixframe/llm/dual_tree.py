"""Exact top-k inner-product search by dual-tree traversal of cover trees.

The top two levels of the tree are shared: a sample of pivots, which grows with the table up to a
bound, parts queries and data alike into small cells, and these into shells by distance from the
pivot, each with its own covering radius.  Neighbouring shells and cells are packed into chunks of
a task's size; a shell that is larger spreads over tasks by hash.  Data stay in their chunk; a query is
sent once to each chunk of which any shell may still hold one of its best.
There one cover tree over the chunk, built once, and one over each block of
arriving queries are traversed together: a pair of nodes is skipped if its bound

    <q, d> + |q| R_d + |d| R_q + R_q R_d        (centres q, d; covering radii R)

is below the worst kth score of the queries under the first node.  Queries first meet their own
cell; the kth scores found there prune whole chunks for them before anything is sent.

Vectors that are null, or hold null or non-finite components, take no part; shorter vectors count
as padded with zeros; ties go to smaller ids; repeated rows are separate candidates, and a query
meets every row but its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import as_numpy, batch_of, materialise

SCALE = 1024
CHUNK = 1 << 15
#: Small tables are dealt to about so many chunks all the same.
TASKS = 64
#: A pivot for so many rows; at the upper bound cells grow with the table.
CELL, PIVOTS, MOST_PIVOTS = 256, 64, 4096
#: Shells to a doubling of the distance.
SHELLS = 4
ROUTED = 1024
QUERY_BLOCK = 2048
LEAF = 512
#: Centres of a node's net, and how much smaller than the node a part is that is parted again.
NET, NARROW = 32, 0.75
#: Queries and rows that are compared at a time.
BLOCK, ROWS = 512, 4096
#: No score yet.
NONE = -(2**63) + 1


class CoverTree:
    """Nodes with a centre, a covering radius and a range of ``order``; a node's parts shrink by ``NARROW`` or are leaves.

    So no branch is deeper than some levels a doubling of the radius, and points that no net of ``NET`` centres covers
    more closely, as those without clusters in many dimensions, stay one leaf of any size.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.first, self.end, self.children, self.radius, self.centre = [], [], [], [], []
        if len(points):
            self._node(0, len(points), 0)

    def _node(self, a: int, b: int, centre: int, split: bool = True) -> int:
        own = self.order[a:b]
        distance = np.linalg.norm(self.points[own] - self.points[centre], axis=1)
        n = len(self.first)
        self.first.append(a)
        self.end.append(b)
        self.centre.append(self.points[centre])
        self.radius.append(float(distance.max()) * (1 + 1e-9))
        self.children.append([])
        if not split or b - a <= LEAF or self.radius[n] == 0:
            return n
        # a net of half the radius: each point joins the first centre that covers it, else is one
        centres, new = [], centre
        near = np.full(b - a, -1)
        free = np.ones(b - a, bool)
        away = np.empty((NET, b - a))
        while free.any() and len(centres) < NET:
            away[len(centres)] = distance = np.linalg.norm(self.points[own] - self.points[new], axis=1)
            mine = free & ((distance <= self.radius[n] / 2) | (own == new))
            near[mine] = len(centres)
            centres.append(new)
            free &= ~mine
            if free.any():
                new = own[free][np.argmax(distance[free])]
        if free.any():  # so many centres do not cover all: the rest join the nearest
            near[free] = away[:, free].argmin(0)
        sizes, own_radius = np.bincount(near, minlength=len(centres)), np.zeros(len(centres))
        np.maximum.at(own_radius, near, away[near, np.arange(b - a)])
        narrow = own_radius <= NARROW * self.radius[n]
        if sizes[narrow].sum() * 2 < b - a:  # parts as wide as the whole rule nothing out
            return n
        self.order[a:b], at = own[np.argsort(near, kind="stable")], a
        for child, size in enumerate(sizes):
            if size:
                self.children[n].append(self._node(at, at + size, int(centres[child]), bool(narrow[child])))
                at += size
        return n


def _exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point only where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search(queries: np.ndarray, own: np.ndarray, worst: np.ndarray, data: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, tree: CoverTree | None = None) -> list[tuple[int, int, int]]:
    """``(query, id, score)``: the best ``k`` of ``data`` for each query, from those not below ``worst``.

    ``own`` and ``rows`` are row numbers by which a query skips itself; ``worst`` is the kth score
    that each query has so far, or minus infinity.  ``tree`` is the data's, if there is one already.
    """
    q_tree, d_tree = CoverTree(queries.astype(np.float64)), tree or CoverTree(data.astype(np.float64))
    worst = worst.copy()
    best, names = np.full((len(queries), k), NONE), np.full((len(queries), k), 2**63 - 1)
    q_norm = [float(np.linalg.norm(c)) for c in q_tree.centre]
    d_norm = [float(np.linalg.norm(c)) for c in d_tree.centre]

    def bound(a: int, b: int) -> float:
        value = float(q_tree.centre[a] @ d_tree.centre[b])
        slack = q_norm[a] * d_tree.radius[b] + d_norm[b] * q_tree.radius[a] + q_tree.radius[a] * d_tree.radius[b]
        return value + slack + 1e-9 * (abs(value) + slack) + 1e-6

    def compare(of: np.ndarray, to: np.ndarray) -> None:
        score = _exact_products(queries[of], data[to])
        possible = (score >= worst[of][:, None]) & (own[of][:, None] != rows[to][None, :])
        many = np.flatnonzero(possible.sum(1) > 4 * k)
        if len(many):  # so that few are sorted: no more than k and ties
            kth = np.partition(np.where(possible[many], score[many], NONE), -k, axis=1)[:, -k]
            possible[many] &= score[many] >= kth[:, None]
        i, j = np.nonzero(possible)
        hit = np.unique(of[i])
        asked = np.concatenate([np.repeat(hit, k), of[i]])
        scores, found = np.concatenate([best[hit].ravel(), score[i, j]]), np.concatenate([names[hit].ravel(), ids[to[j]]])
        top = np.lexsort((found, -scores, asked))
        first = np.searchsorted(asked[top], hit)
        top = top[(first[:, None] + np.arange(k)[None, :]).ravel()].reshape(-1, k)  # a query has k rows at least
        best[hit], names[hit] = scores[top], found[top]
        full = best[hit, -1] != NONE
        worst[hit[full]] = np.maximum(worst[hit[full]], best[hit[full], -1])

    stack = [(0, 0, bound(0, 0))] if len(queries) and len(data) else []
    while stack:
        a, b, limit = stack.pop()
        if limit < worst[q_tree.order[q_tree.first[a] : q_tree.end[a]]].min():
            continue
        if q_tree.children[a] and (q_tree.radius[a] >= d_tree.radius[b] or not d_tree.children[b]):
            pairs = [(c, b) for c in q_tree.children[a]]
        elif d_tree.children[b]:
            pairs = [(a, c) for c in d_tree.children[b]]
        else:
            of, to = q_tree.order[q_tree.first[a] : q_tree.end[a]], d_tree.order[d_tree.first[b] : d_tree.end[b]]
            for i in range(0, len(of), BLOCK):
                for j in range(0, len(to), ROWS):
                    compare(of[i : i + BLOCK], to[j : j + ROWS])
            continue
        stack += sorted(((x, y, bound(x, y)) for x, y in pairs), key=lambda p: p[2])
    q, place = np.nonzero(best != NONE)
    return list(zip(q.tolist(), names[q, place].tolist(), best[q, place].tolist(), strict=True))


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~bad


def sampled(tagged: DataFrame, n: int, wanted: int) -> list[list[int]]:
    """About ``wanted`` of ``n`` rows' vectors, by a hash of id and vector: equal vectors count as often as they occur."""
    drawn = F.xxhash64("vec_id", "v")
    rows = tagged
    if n > 8 * wanted:  # so that few rows are sorted
        rows = tagged.where(drawn < int(-(2**63) + 2**64 * (4 * wanted / n)))
    return [r.v for r in rows.select("v", drawn.alias("drawn")).orderBy("drawn", "v").limit(wanted).collect()]


def neighbours_first(centres: np.ndarray) -> np.ndarray:
    """Each pivot's place in an order that keeps near ones together: by the nearest of a few, then by distance from it."""
    f = centres.astype(np.float64)
    few = f[:: math.isqrt(max(1, len(f) - 1)) + 1]
    square = (f**2).sum(1)[:, None] + (few**2).sum(1)[None, :] - 2 * f @ few.T
    place = np.empty(len(f), np.int64)
    place[np.lexsort((square.min(1), square.argmin(1)))] = np.arange(len(f))
    return place


def chunks_of(groups: list, place: np.ndarray, size: int) -> list[tuple[int, int, int, int, float]]:
    """``cell, shell, chunk, parts, radius`` of ``groups (cell, shell, n, radius)``.

    Neighbours share a chunk while it holds at most ``size`` rows; one that holds more has a chunk of several parts.
    """
    out, chunk, held = [], -1, size
    for row in sorted(groups, key=lambda r: (place[r.cell], r.shell)):
        if held + row.n > size:
            chunk, held = chunk + 1, 0
        held += row.n
        out.append((row.cell, row.shell, chunk, math.ceil(row.n / size) if row.n > size else 1, row.radius * (1 + 1e-9)))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` over ``vectors (vec_id long, v array<long>)``.

    ``pivots`` is one for ``CELL`` rows unless given, and within ``PIVOTS`` and ``MOST_PIVOTS``.
    """
    spark = vectors.sparkSession
    tagged = vectors.select("vec_id", "v", is_query.alias("q"))
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    dim, top, n = tagged.agg(F.max(F.size("v")), largest, F.count("*")).first()
    dim, kind = dim or 1, "<i4" if (top or 0) < 1 << 31 else "<i8"
    pivots = pivots or min(max(PIVOTS, math.ceil(n / CELL)), MOST_PIVOTS)
    centres = np.array([v + [0] * (dim - len(v)) for v in sampled(tagged, n, pivots)], np.int64).reshape(-1, dim)
    centres = np.unique(centres, axis=0) if len(centres) else np.zeros((1, dim), np.int64)
    shared = spark.sparkContext.broadcast(centres)  # MOST_PIVOTS vectors at most
    placed_as = pa.schema([("vec_id", pa.int64()), ("q", pa.bool_()), ("cell", pa.int32()), ("shell", pa.int32()), ("away", pa.float64()), ("vec", pa.binary())])

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = shared.value.astype(np.float64)
        for whole in batches:
            for batch in (whole.slice(i, ROUTED) for i in range(0, whole.num_rows, ROUTED)):
                rows = [x + [0] * (dim - len(x)) for x in batch.column("v").to_pylist()]
                v = np.array(rows, kind).reshape(-1, dim)
                f = v.astype(np.float64)
                cell = np.argmin((pivot**2).sum(1)[None, :] - 2 * f @ pivot.T, axis=1)
                away = np.linalg.norm(f - pivot[cell], axis=1)
                shell = np.floor(SHELLS * np.log2(away + 1)).astype(np.int32)
                yield batch_of(placed_as, [batch.column("vec_id"), batch.column("q"), cell.astype(np.int32), shell, away, [x.tobytes() for x in v]])

    placed = tagged.mapInArrow(place, "vec_id long, q boolean, cell int, shell int, away double, vec binary")
    placed = materialise(placed.withColumn("row", F.monotonically_increasing_id()), "cells")
    groups = placed.groupBy("cell", "shell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # some shells a pivot
    chunks = chunks_of(groups, neighbours_first(centres), min(CHUNK, max(1, math.ceil(n / TASKS))))
    where = spark.createDataFrame(chunks, "own_cell int, shell int, chunk int, parts int, radius double").drop("radius")
    of_cell, of_chunk, n_parts = (np.array([x[i] for x in chunks], np.int32) for i in (0, 2, 3))
    radii, at = np.array([x[4] for x in chunks]), np.flatnonzero(np.diff(of_chunk, prepend=-1))  # where each chunk begins
    step = max(1, min(ROUTED, (1 << 22) // max(1, len(chunks))))
    none = F.lit(float("-inf"))
    # a data row's kth score is null; so it comes before the queries of its chunk
    part = F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part")
    kept = placed.withColumnRenamed("cell", "own_cell").join(F.broadcast(where), ["own_cell", "shell"])  # a row for some shells a pivot
    data = kept.select("chunk", part, "row", "vec_id", "vec", F.lit(None).cast("double").alias("worst"))
    queries = placed.where("q").select("cell", "row", "vec_id", "vec")
    names, ddl = ["chunk", "part", "row", "vec_id", "vec", "worst"], "chunk int, part int, row long, vec_id long, vec binary, worst double"
    routed_as = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("vec", pa.binary()), ("worst", pa.float64())])
    found_as = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def route(at_home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivot = shared.value.astype(np.float64)
            for whole in batches:
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    cells, worst = as_numpy(batch.column("cell")), as_numpy(batch.column("worst"))
                    go = np.logical_or.reduceat(cells[:, None] == of_cell[None, :], at, axis=1)
                    if not at_home:
                        f = matrix(batch.column("vec")).astype(np.float64)
                        limit = (f @ pivot.T)[:, of_cell] + np.linalg.norm(f, axis=1)[:, None] * radii[None, :]
                        go = ~go & np.logical_or.reduceat(limit + 1e-9 * np.abs(limit) + 1e-6 >= worst[:, None], at, axis=1)
                    of, to = np.nonzero(go)
                    for i in range(0, len(of), ROUTED):
                        times = n_parts[at[to[i : i + ROUTED]]]
                        chunk = np.repeat(to[i : i + ROUTED], times).astype(np.int32)
                        part = np.arange(len(chunk)) - np.repeat(np.cumsum(times) - times, times)
                        sent = batch.take(pa.array(np.repeat(of[i : i + ROUTED], times)))
                        yield batch_of(routed_as, [chunk, part.astype(np.int32), *(sent.column(c) for c in names[2:])])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by chunk, data first: a chunk is held, queries stream past it in blocks."""
        current, tree = None, None
        held: list[tuple] = []
        rows, ids, vectors = None, None, None
        waiting: list[tuple] = []

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal tree, rows, ids, vectors
            if waiting and held and tree is None:
                rows, ids, vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
                tree = CoverTree(vectors.astype(np.float64))
            if waiting and tree is not None:
                own, names_, q, worst = (np.concatenate([w[i] for w in waiting]) for i in range(4))
                found = search(q, own, worst, vectors, rows, ids, k, tree)
                of, hit, score = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
                yield batch_of(found_as, [own[of], names_[of], hit, score])
            waiting.clear()

        for batch in batches:
            chunk = as_numpy(batch.column("chunk")).astype(np.int64) << 32 | as_numpy(batch.column("part"))
            row, vec_id, worst = (as_numpy(batch.column(c)) for c in ("row", "vec_id", "worst"))
            is_data = np.array(batch.column("worst").is_null())
            change = np.flatnonzero((chunk[1:] != chunk[:-1]) | (is_data[1:] != is_data[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(chunk)], strict=True):
                if a == b:
                    continue
                if chunk[a] != current:
                    yield from ask()
                    current, tree, held = chunk[a], None, []
                part = matrix(batch.column("vec").slice(a, b - a))
                if is_data[a]:
                    held.append((row[a:b], vec_id[a:b], part))
                else:
                    for i in range(0, b - a, QUERY_BLOCK):
                        j = min(i + QUERY_BLOCK, b - a)
                        waiting.append((row[a + i : a + j], vec_id[a + i : a + j], part[i:j], worst[a + i : a + j]))
                        if sum(len(w[0]) for w in waiting) >= QUERY_BLOCK:
                            yield from ask()
        yield from ask()

    def compared(asked: DataFrame, at_home: bool) -> DataFrame:
        sent = asked.select("cell", *names[2:]).mapInArrow(route(at_home), ddl)
        met = data.select(*names).unionByName(sent).repartition("chunk", "part").sortWithinPartitions("chunk", "part", F.asc_nulls_first("worst"))
        return met.mapInArrow(meet, "row long, query_id long, vec_id long, score long")

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    home = materialise(compared(queries.withColumn("worst", none), True), "home")
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("worst"))
    asked = queries.join(kth, "row", "left").withColumn("worst", F.coalesce("worst", none))
    every = home.unionByName(compared(asked, False)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_dual_tree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
