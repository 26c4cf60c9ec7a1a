"""Embedding near-duplicates by an exact metric range join over pivot cells.

Unit vectors under the angle between them are a metric space; a cosine of 0.95 is a range of 18.2
degrees.  Each vector belongs to the cell of its nearest pivot: to its core, within half the range,
where any two members link without being compared, or to its outer part.  A vector is sent to
another cell only if the triangle inequality with the cell's covering radius, and the distance to
the plane between the two pivots, leave room for a link; if the inequality shows that it links with
a whole core, one count and one link to the pivot stand for all.  Each pair of cells meets once: the
lower-ranked one's vectors go to the other, cores rank last.  Cells are put together in bins of
bounded size, larger cells are split, and bins join on their own: blocks of arriving vectors are
multiplied with the bin's, and only counts and a spanning set of links leave a task.

Vectors that are null, zero, or hold null or non-finite components link with nothing but stay;
shorter vectors count as padded with zeros; repeated rows and ids are vectors of their own, and a
component's id is its least id that is not null; ``kept`` is false for null ids.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import as_numpy, batch_of, materialise
from .dual_tree import usable

COSINE = 0.95
PIVOTS = 64
#: Sampled pivots grow with the table: one for so many vectors.
PER_PIVOT = 4096
#: Vectors of one bin, and of a block that meets it.
BIN = 8192
ARRIVING = 1024
#: Angles are decided with this much to spare, else vectors are compared.
SLACK = 1e-6


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _spanning(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row or column of a boolean matrix to the least row number it reaches there."""
    some, any_ = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked, rows, columns = linked[np.ix_(some, any_)], rows[some], columns[any_]
    top = np.iinfo(np.int64).max
    of_row, of_column = rows.copy(), columns.copy()
    while True:
        found = np.minimum(of_row, np.where(linked, of_column[None, :], top).min(1, initial=top))
        back = np.minimum(of_column, np.where(linked, found[:, None], top).min(0, initial=top))
        if np.array_equal(found, of_row) and np.array_equal(back, of_column):
            break
        of_row, of_column = found, back
    u, v = np.concatenate([rows, columns]), np.concatenate([of_row, of_column])
    return u[u != v], v[u != v]


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of ``a`` and ``b`` reach the cosine in double precision.

    Single precision decides all pairs that are farther from the bound than its rounding.
    """
    near = a.astype(np.float32) @ b.astype(np.float32).T
    margin = np.float32(1e-6 + 1.2e-7 * a.shape[1])
    hit = near >= np.float32(cosine) + margin
    i, j = np.nonzero((near >= np.float32(cosine) - margin) & ~hit)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        hit[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return hit


def near_links(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, per_pivot: int = PER_PIVOT, bin_size: int = BIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of ``vectors (vec_id, embedding)``: all rows, their links counted, spanning links.

    ``row, vec_id`` has every row; ``row, n_links`` those with links; ``u, v`` (rows) connect what
    links connect.
    """
    spark = vectors.sparkSession
    reach = math.acos(cosine)
    good = usable(F.col("embedding")) & F.exists("embedding", lambda c: c != 0)
    rows = materialise(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("row", F.monotonically_increasing_id()), "vectors")
    able = rows.where(F.coalesce(good, F.lit(False)))
    n, d = able.agg(F.count("*"), F.max(F.size("embedding"))).first()
    d = d or 1
    unit_as = pa.schema([("row", pa.int64()), ("vec", pa.binary())])

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            v = np.zeros((batch.num_rows, d))
            v[np.arange(d)[None, :] < as_numpy(column.value_lengths()).astype(np.int64)[:, None]] = as_numpy(column.flatten()).astype(np.float64)
            v /= np.abs(v).max(1, keepdims=True, initial=0)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield batch_of(unit_as, [batch.column("row"), [x.tobytes() for x in v]])

    units = materialise(able.select("row", "embedding").mapInArrow(unit, "row long, vec binary"), "units")
    wanted = max(pivots, n // per_pivot)
    sample = units.orderBy(F.xxhash64("vec"), "row").limit(wanted).collect()  # a row for PER_PIVOT vectors
    centres, centre_rows = np.zeros((0, d)), []
    for r in sample:  # of sampled vectors in one core's reach, one is a pivot
        v = np.frombuffer(r.vec)
        if not len(centres) or (centres @ v).max() < math.cos(reach / 2):
            centres = np.vstack([centres, v])
            centre_rows.append(r.row)
    k = len(centres)
    shared = spark.sparkContext.broadcast((centres, np.array(centre_rows, np.int64), centres @ centres.T))  # at most a pivot for PER_PIVOT vectors
    placed_as = pa.schema([("row", pa.int64()), ("cell", pa.int32()), ("away", pa.float64()), ("vec", pa.binary())])

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, d)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches so small that a number for each row and cell is no burden."""
        rows = max(1, (1 << 22) // max(1, 2 * k))
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            near = matrix(batch.column("vec")) @ shared.value[0].T
            home = near.argmax(1)
            away = _angle(near[np.arange(len(home)), home])
            cell = 2 * home + (away > reach / 2 - SLACK)
            yield batch_of(placed_as, [batch.column("row"), cell.astype(np.int32), away, batch.column("vec")])

    placed = materialise(units.mapInArrow(place, "row long, cell int, away double, vec binary"), "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # two rows a pivot
    radius, size = np.full(2 * k, -1.0), np.zeros(2 * k, np.int64)
    for r in stats:
        radius[r.cell], size[r.cell] = r.radius + SLACK, r.n
    # smaller cells go to larger ones, outer parts to cores
    rank = np.empty(2 * k, np.int64)
    rank[np.lexsort((np.arange(2 * k), size, np.arange(2 * k) % 2 == 0))] = np.arange(2 * k)
    first_bin, parts, bins, room = np.zeros(2 * k, np.int64), np.ones(2 * k, np.int64), 0, 0
    for c in np.flatnonzero(size):
        if size[c] > bin_size:
            parts[c] = -(-size[c] // bin_size)
            first_bin[c], bins, room = bins, bins + parts[c], 0
        else:
            if room < size[c]:
                bins, room = bins + 1, bin_size
            first_bin[c] = bins - 1
            room -= size[c]
    layout = spark.sparkContext.broadcast((radius, size, rank, first_bin, parts))
    routed_as = pa.schema([("bin", pa.int32()), ("member", pa.bool_()), ("row", pa.int64()), ("cell", pa.int32()), ("vec", pa.binary())])
    found_as = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])
    gap = math.sqrt(2 - 2 * cosine) + SLACK

    def relation(v: np.ndarray, cell: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and cell of ``among``: whether it links with all of the cell, and whether it must be sent there."""
        centre, _, between = shared.value
        radius, size, rank, _, _ = layout.value
        home, pivot = cell // 2, among // 2
        near = v @ centre[pivot].T
        away = _angle(near)
        other = (rank[among][None, :] > rank[cell][:, None]) & (size[among] > 0)
        every = other & (among % 2 == 0) & (away + radius[among] <= reach - SLACK)
        lead = np.einsum("ij,ij->i", v, centre[home])[:, None] - near
        plane = lead > gap * np.sqrt(np.maximum(2 - 2 * between[home][:, pivot], 0)) + SLACK
        return every, other & ~every & ~plane & (away - radius[among] <= reach + SLACK)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What pivots decide: links with whole cores.  ``v`` is the linked pivot, or minus one and a core for ``n`` more links of each member."""
        for batch in pieces(batches):
            v, row, cell = matrix(batch.column("vec")), as_numpy(batch.column("row")), as_numpy(batch.column("cell"))
            _, centre_row, _ = shared.value
            size = layout.value[1]
            every, _ = relation(v, cell, np.arange(2 * k))
            own = np.where(cell % 2 == 0, size[cell] - 1, 0) + every @ size
            at = np.flatnonzero(own > 0)
            # one link a vector, and links between the cores that it joins
            core = np.where(cell % 2 == 0, cell, np.where(every.any(1), every.argmax(1), -1))
            u, to = row[core >= 0], centre_row[core[core >= 0] // 2]
            i, c = np.nonzero(every & (core >= 0)[:, None])
            joined = np.unique(np.stack([core[i], c]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
            u = np.concatenate([u, centre_row[joined[0] // 2]])
            to = np.concatenate([to, centre_row[joined[1] // 2]])
            more = every.sum(0)
            c = np.flatnonzero(more)
            yield batch_of(found_as, [
                np.concatenate([u[u != to], row[at], c]), np.concatenate([to[u != to], np.full(len(at), -2), np.full(len(c), -1)]),
                np.concatenate([np.zeros((u != to).sum(), np.int64), own[at], more[c]]),
            ])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v, row, cell = matrix(batch.column("vec")), as_numpy(batch.column("row")), as_numpy(batch.column("cell"))
            _, _, _, first_bin, parts = layout.value
            _, send = relation(v, cell, np.arange(2 * k))
            own_part = (row * 0x9E3779B1 >> 16) % parts[cell]
            own_bin = first_bin[cell] + own_part
            goes = np.zeros((len(row), bins), bool)
            for c in np.flatnonzero(send.any(0)):
                goes[:, first_bin[c] : first_bin[c] + parts[c]] |= send[:, [c]]
            for c in np.unique(cell[(parts[cell] > 1) & (cell % 2 == 1)]):  # a split cell's later parts
                later = np.arange(parts[c])[None, :] > own_part[:, None]
                goes[:, first_bin[c] : first_bin[c] + parts[c]] |= later & (cell == c)[:, None]
            goes[np.arange(len(row)), own_bin] = False  # there all members meet
            columns = [batch.column(x) for x in ("row", "cell", "vec")]
            yield batch_of(routed_as, [own_bin.astype(np.int32), np.ones(len(row), bool), *columns])
            for b in np.flatnonzero(goes.any(0)):
                sent = pa.array(np.flatnonzero(goes[:, b]))
                yield batch_of(routed_as, [np.full(len(sent), b, np.int32), np.zeros(len(sent), bool), *(c.take(sent) for c in columns)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by bin, members first and by cell: the bin is held, others stream past it."""
        current, held, waiting = None, [], []
        rows, cells, vectors, totals, edges = None, None, None, None, {}

        def compare(a: tuple, b: slice, half: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            row, _, v = a
            hit = linked(v, vectors[b], cosine)
            if half:
                hit &= row[:, None] < rows[b][None, :]
            if not hit.any():
                return None
            totals[b] += hit.sum(0)
            return hit.sum(1), *_spanning(hit, row, rows[b])

        def flush() -> Iterator[pa.RecordBatch]:
            """Members with links, and the links that connect them."""
            nonlocal held
            if held:
                freeze()
            if rows is not None:
                at = np.flatnonzero(totals)
                yield batch_of(found_as, [rows[at], np.full(len(at), -2), totals[at]])

        def freeze() -> None:
            nonlocal rows, cells, vectors, totals, edges, held
            rows, cells, vectors = (np.concatenate([h[i] for h in held]) for i in range(3))
            totals, held = np.zeros(len(rows), np.int64), []
            bounds = np.flatnonzero(np.diff(cells)) + 1
            edges = {int(cells[a]): slice(a, b) for a, b in zip([0, *bounds], [*bounds, len(cells)], strict=True)}

        def give(row: np.ndarray, found: list) -> Iterator[pa.RecordBatch]:
            for n, u, v in (x for x in found if x is not None):
                at = np.flatnonzero(n)
                yield batch_of(found_as, [np.concatenate([row[at], u]), np.concatenate([np.full(len(at), -2), v]), np.concatenate([n[at], np.zeros(len(u), np.int64)])])

        def within() -> Iterator[pa.RecordBatch]:
            """Members of outer parts with their own cell, and with other cells of the bin that they must meet."""
            for a in range(0, len(rows), ARRIVING):
                own = slice(a, min(a + ARRIVING, len(rows)))
                _, send = relation(vectors[own], cells[own], np.array(list(edges)))
                outer = cells[own] % 2 == 1
                for at, (c, b) in enumerate(edges.items()):
                    pick = np.flatnonzero(send[:, at])
                    if len(pick):
                        part = tuple(x[own][pick] for x in (rows, cells, vectors))
                        yield from give(part[0], [compare(part, b, False)])
                    pick = np.flatnonzero(outer & (cells[own] == c))
                    if len(pick):
                        part = tuple(x[own][pick] for x in (rows, cells, vectors))
                        yield from give(part[0], [compare(part, b, True)])

        def ask() -> Iterator[pa.RecordBatch]:
            if waiting and rows is not None:
                row, cell, v = (np.concatenate([w[i] for w in waiting]) for i in range(3))
                _, send = relation(v, cell, np.array(list(edges)))
                for at, (c, b) in enumerate(edges.items()):
                    pick = np.flatnonzero(send[:, at] | (cell == c))  # of its own cell: a part of a split one
                    if len(pick):
                        yield from give(row[pick], [compare((row[pick], cell[pick], v[pick]), b, False)])
            waiting.clear()

        for batch in batches:
            bin_, member = as_numpy(batch.column("bin")), as_numpy(batch.column("member"))
            row, cell = as_numpy(batch.column("row")), as_numpy(batch.column("cell"))
            change = np.flatnonzero((bin_[1:] != bin_[:-1]) | (member[1:] != member[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(bin_)], strict=True):
                if a == b:
                    continue
                if bin_[a] != current:
                    yield from ask()
                    if held:
                        freeze()
                        yield from within()
                    yield from flush()
                    current, held, rows = bin_[a], [], None
                part = matrix(batch.column("vec").slice(a, b - a))
                if member[a]:
                    held.append((row[a:b], cell[a:b], part))
                    continue
                if held:
                    freeze()
                    yield from within()
                for i in range(a, b, ARRIVING):
                    j = min(i + ARRIVING, b)
                    waiting.append((row[i:j], cell[i:j], part[i - a : j - a]))
                    if sum(len(w[0]) for w in waiting) >= ARRIVING:
                        yield from ask()
        yield from ask()
        if held:
            freeze()
            yield from within()
        yield from flush()

    found_ddl = "u long, v long, n long"
    sure = materialise(placed.mapInArrow(counts, found_ddl), "sure")
    routed = placed.mapInArrow(route, "bin int, member boolean, row long, cell int, vec binary")
    met = routed.repartition("bin").sortWithinPartitions("bin", F.desc("member"), "cell").mapInArrow(meet, found_ddl)
    met = materialise(met, "met")
    both = sure.unionByName(met)
    cores = sure.where("v = -1").groupBy(F.col("u").cast("int").alias("cell")).agg(F.sum("n").alias("n"))  # a row a pivot at most
    of_cores = placed.where(F.col("cell") % 2 == 0).join(F.broadcast(cores), "cell").select(F.col("row").alias("u"), "n")
    n_links = both.where("v = -2").select("u", "n").unionByName(of_cores).groupBy(F.col("u").alias("row")).agg(F.sum("n").alias("n_links"))
    return rows.select("row", "vec_id"), n_links, both.where("v >= 0").select("u", "v")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **sizes: int) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding)``."""
    rows, n_links, links = near_links(vectors, cosine, **sizes)
    roots = materialise(connected_components(links), "roots")
    least = roots.join(rows, roots["u"] == rows["row"]).groupBy("root").agg(F.min("vec_id").alias("component_id"))
    of_row = roots.join(least, "root").select(F.col("u").alias("row"), "component_id")
    every = rows.join(n_links, "row", "left").join(of_row, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op13_metric_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
