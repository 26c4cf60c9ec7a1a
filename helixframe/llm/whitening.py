"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed passes.

The covariance is never formed.  Each different quantised vector is packed once into row blocks in
the shared folder; a pass sends an orthonormal block ``Q`` to the tasks, which return their share
of the centred ``X'X Q``.  Shares are summed in tasks first, so the driver sees a bounded number of
``d x block`` matrices.  A Chebyshev recurrence of such passes damps the spectrum below the block's
smallest Ritz value; QR and a Rayleigh-Ritz step follow, until every wanted pair is certified: its
residual is at the rounding level of the largest eigenvalue.

Vectors that are null, or hold null or non-finite components, are dropped; shorter vectors count as
padded with zeros; repeated rows get a row each but count once in the fit; null ids stay null.
Components are limited to the rank: a table of one distinct vector, or an empty one, gives no rows.
Components of over 2^39 in size count as that.  A deviation that does not fit a long is null.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, as_numpy, batch_of, materialise
from .dual_tree import usable

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
DEGREE = 12
#: Ritz pairs this far below the largest eigenvalue are beyond the rank.
RANK = 1e-12
#: Residuals, as a share of the largest eigenvalue: certified at once, or where they fall no more.
TIGHT, CERTIFIED = 1e-14, 1e-10
ROUNDS = 500
#: Matrices that reach the driver from one pass, at most.
FAN = 32
BLOCK_ROWS = 4096
LARGEST = float(1 << 45)


@dataclass
class Spectrum:
    """Leading eigenpairs of the fit list's covariance, with what certifies them."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def packed(rows: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int, str]:
    """``vec_id, x binary`` of ``rows (vec_id, embedding)``: ``floor(scale * c)`` as integers; their number and type."""
    good = rows.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    d, top = good.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", lambda c: F.abs(c.cast("double")))))).first()
    d, kind = d or 0, "<i4" if (top or 0) * scale < 1 << 30 else "<i8"
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            size = as_numpy(column.value_lengths()).astype(np.int64)
            x = np.zeros((batch.num_rows, d))
            x[np.arange(d)[None, :] < size[:, None]] = as_numpy(column.flatten()).astype(np.float64)
            x = np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(kind)
            yield batch_of(schema, [batch.column("vec_id"), [r.tobytes() for r in x]])

    return good.mapInArrow(quantise, "vec_id long, x binary"), d, kind


def _blocks(rows: DataFrame) -> DataFrame:
    """Each different ``x`` once, joined to blocks of rows."""
    schema = pa.schema([("block", pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("x").to_pylist()
            for i in range(0, len(own), BLOCK_ROWS):
                yield batch_of(schema, [[b"".join(own[i : i + BLOCK_ROWS])]])

    return materialise(rows.select("x").distinct().mapInArrow(join, "block binary"), "fit")


def _total(blocks: DataFrame, tasks: int, work: Callable[[np.ndarray], np.ndarray], d: int, kind: str, out: str) -> np.ndarray | None:
    """The sum of ``work(rows)`` over all blocks; of many tasks' sums, tasks add up shares first."""
    schema = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])

    def give(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield batch_of(schema, [[TaskContext.get().partitionId() % FAN], [total.astype(out).tobytes()]])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in as_bytes(batch.column("block")):
                share = work(block.view(kind).reshape(-1, d))
                total = share if total is None else total + share
        yield from give(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for share in as_bytes(batch.column("sums")):
                total = share.view(out).copy() if total is None else total + share.view(out)
        yield from give(total)

    ddl = "slot int, sums binary"
    shares = blocks.mapInArrow(partial, ddl)
    if tasks > FAN:
        shares = shares.repartition(FAN, "slot").mapInArrow(merge, ddl)
    found = sorted((r.slot, bytes(r.sums)) for r in shares.collect())  # FAN rows at most
    return sum(np.frombuffer(s, out) for _, s in found) if found else None


def _filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance on ``q``: small on [0, low], one at ``top``."""
    half = low / 2
    sigma = first = half / (half - top)
    before, now = q, (apply(q) - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * after / half * (apply(now) - half * now) - sigma * after * before
        sigma = after
    return now


def spectrum(blocks: DataFrame, d: int, kind: str, k: int = COMPONENTS, block: int | None = None, degree: int = DEGREE, seed: int = 1) -> Spectrum | None:
    """The ``k`` leading eigenpairs of the covariance (divisor n) of all rows in ``blocks``."""
    tasks = blocks.rdd.getNumPartitions()

    def counted(m: np.ndarray) -> np.ndarray:
        m = m.astype(np.int64)
        return np.concatenate([[len(m)], (m >> 20).sum(0), (m & 0xFFFFF).sum(0)])

    found = _total(blocks, tasks, counted, d, kind, "<i8") if d else None
    if found is None:
        return None
    n = int(found[0])
    sums = [(int(h) << 20) + int(low) for h, low in zip(found[1 : d + 1], found[d + 1 :], strict=True)]
    mean = np.array([s / n for s in sums])
    trace = float(_total(blocks, tasks, lambda m: ((m - mean) ** 2).sum(keepdims=True)[0], d, kind, "<f8")[0]) / n
    if trace == 0:
        return None
    width, passes = min(d, block or 3 * k), 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        sent = blocks.sparkSession.sparkContext.broadcast(q)  # d x width numbers

        def work(m: np.ndarray) -> np.ndarray:
            z = m - mean
            return (z.T @ (z @ sent.value)).ravel()

        try:
            return _total(blocks, tasks, work, d, kind, "<f8").reshape(d, -1) / n
        finally:
            sent.destroy()

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        image = apply(q)
        ritz = q.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        worst = float(np.linalg.norm(image - q * values, axis=0)[:k].max() / values[0])
        if worst <= TIGHT or worst <= CERTIFIED and worst > last / 2:
            kept = values[:k] > RANK * values[0]
            return Spectrum(n, sums, mean, values[:k][kept], q[:, :k][:, kept], trace, worst, passes)
        last = worst
        low = max(float(values[-1]), 1e-9 * float(values[0]))
        q = np.linalg.qr(_filtered(apply, q, low, float(values[0]), degree))[0]
    raise ArithmeticError(f"not certified after {passes} passes: residual {last:.3g} of the largest eigenvalue")


def whiten(rows: DataFrame, k: int = COMPONENTS, scale: int = SCALE, block: int | None = None, degree: int = DEGREE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, residual``."""
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    vectors, d, kind = packed(rows, scale)
    vectors = materialise(vectors, "quantised")
    blocks = _blocks(vectors)
    found = spectrum(blocks, d, kind, k, block, degree)
    if found is None:
        return rows.sparkSession.createDataFrame([], ddl)
    mean, n = found.mean, found.n
    turn = found.vectors / np.sqrt(found.values)
    wide = turn.shape[1]

    def moments(m: np.ndarray) -> np.ndarray:
        w = (m - mean) @ turn
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = _total(blocks, blocks.rdd.getNumPartitions(), moments, d, kind, "<f8") / n
    middle, second = got[:wide], got[wide:].reshape(wide, wide)
    error = float(np.abs(second - np.outer(middle, middle) - np.eye(wide)).max())
    explained = found.values / found.trace
    # modulo 2^64: exact wherever the true deviation fits a long
    wrapped_n = np.array([n], np.uint64).view(np.int64)[0]
    wrapped = np.array([s % (1 << 64) for s in found.sums], np.uint64).view(np.int64)
    residual = found.residual
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
        ("explained", pa.float64()), ("identity_error", pa.float64()), ("residual", pa.float64()),
    ])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), kind).reshape(-1, d).astype(np.int64)
            z = x - mean
            large = ((z * n) ** 2).sum(1) > 9.2e18
            deviation = ((wrapped_n * x - wrapped) ** 2).sum(1)
            m = len(x) * wide
            yield batch_of(schema, [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), wide))), np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x)), np.full(m, n),
                pa.array(np.repeat(deviation, wide), mask=np.repeat(large, wide)), (z @ turn).ravel(), np.tile(explained, len(x)), np.full(m, error), np.full(m, residual),
            ])

    return vectors.mapInArrow(project, ddl)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
