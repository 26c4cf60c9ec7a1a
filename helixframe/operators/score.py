"""Scoring of reads by a supplied model, sequence features and a forest baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.seq import revcomp, sigmoid
from .fragment import _pieces

BASES = "ACGT"


def encode(seqs: pd.Series, length: int) -> np.ndarray:
    """(n, length, 4) one-hot; what is no A, C, G, T is zero."""
    code = np.full(256, 4, np.int8)
    for i, b in enumerate(BASES):
        code[ord(b)] = code[ord(b.lower())] = i
    rows = np.stack([np.frombuffer(s[:length].ljust(length, "N").encode("latin-1", "replace"), np.uint8) for s in seqs])
    return np.eye(5, 4, dtype=np.float32)[code[rows]]


def score_reads(reads: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], length: int = 250, batch: int = 512, rc: bool = False, replicates: int = 1) -> DataFrame:
    """``read_id, replicate, p`` by ``make_scorer()``, built once a task and fed batches of one-hot reads."""
    source = reads.select("read_id", revcomp(F.col("seq"), length).alias("seq") if rc else F.col("seq"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                x = encode(part["seq"], length)
                for r in range(replicates):
                    p = np.asarray(scorer(x), np.float64).reshape(len(part), -1)[:, 0]
                    yield pd.DataFrame({"read_id": part["read_id"], "replicate": r, "p": p})

    return source.mapInPandas(run, "read_id long, replicate int, p double")


def onnx_scorer(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Scorer factory for a model file that every executor can read."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return make


def linear_score(seq: Column, weights: dict[str, float], bias: float, length: int) -> Column:
    """Built-in scorer: sigmoid of weighted base shares, as one expression."""
    count = lambda b: F.length(seq) - F.length(F.replace(seq, F.lit(b)))
    return sigmoid(sum((w * count(b) / length for b, w in weights.items()), F.lit(bias)))


#: Letters of a sequence that are coded at a time.
PIECE = 1 << 18
#: k-mers up to this length are counted in one array a sequence, longer ones by piece.
DENSE = 6
#: Longest k-mer whose code fits a long.
LONGEST = 31


def code_windows(letters: np.ndarray, k: int, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A code of two bits a letter (0 to 3) for each place where a k-mer may start, and whether it has no other letter.

    ``folded`` codes a k-mer and its reverse complement alike, by the lesser of the two.
    """
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    other = np.concatenate([[0], np.cumsum(letters > 3)])
    code, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    two = np.minimum(letters, 3).astype(np.int64)
    for j in range(k):
        code = code << 2 | two[j : j + n]
        if folded:
            back |= (3 - two[j : j + n]) << 2 * j
    return np.minimum(code, back) if folded else code, other[k:] == other[:-k]


def rolling_codes(letters: np.ndarray, k: int, folded: bool = False) -> np.ndarray:
    """Codes of all k-mers without other letters, in order."""
    code, good = code_windows(letters, k, folded)
    return code[good]


def _letter_codes() -> np.ndarray:
    letter = np.full(256, 4, np.uint8)
    letter[[ord(b) for b in BASES]] = range(4)
    return letter


def kmer_codes(reads: DataFrame, k: int, folded: bool = False, piece: int = PIECE, key: str = "read_id") -> DataFrame:
    """``key, code, n``: codes of each sequence's k-mers and how often it has them.

    A sequence is coded in overlapping pieces, so memory follows the piece and the different codes,
    not the sequence.  Nulls and sequences without a k-mer of A, C, G, T have no row.
    """
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k is from 1 to {LONGEST}")
    letter = _letter_codes()
    source = reads.where("seq is not null").select(key, F.col("seq").cast("binary").alias("seq"))
    first = to_arrow_schema(source.schema).field(0)
    schema = pa.schema([first, ("code", pa.int64()), ("n", pa.int64())])

    def counts(seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.zeros(4**k, np.int64) if k <= DENSE else None
        for at in range(0, max(len(seq) - k + 1, 0), piece):
            codes = rolling_codes(letter[seq[at : at + piece + k - 1]], k, folded)
            if total is None:
                yield np.unique(codes, return_counts=True)
            else:
                total += np.bincount(codes, minlength=len(total))
        if total is not None:
            code = np.flatnonzero(total)
            yield code, total[code]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, ns, held = [], [], [], 0
            for i, seq in enumerate(batch.column(1)):
                for code, n in counts(np.frombuffer(seq.as_buffer(), np.uint8)):
                    rows.append(np.full(len(code), i))
                    codes.append(code)
                    ns.append(n)
                    held += len(code)
                    if held >= piece:
                        yield table(batch, rows, codes, ns)
                        rows, codes, ns, held = [], [], [], 0
            if held:
                yield table(batch, rows, codes, ns)

    def table(batch: pa.RecordBatch, rows: list, codes: list, ns: list) -> pa.RecordBatch:
        own = batch.column(0).take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([own.cast(first.type), pa.array(np.concatenate(codes)), pa.array(np.concatenate(ns).astype(np.int64))], schema=schema)

    kind = source.schema[0].dataType.simpleString()
    each = source.mapInArrow(run, f"{key} {kind}, code long, n long")
    return each.groupBy(key, "code").agg(F.sum("n").alias("n"))


def kmer_text(code: Column, k: int) -> Column:
    """Letters of a code of ``kmer_codes``."""
    letter = lambda i: F.substring(F.lit(BASES), (F.shiftright(code, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return F.concat(*(letter(i) for i in reversed(range(k))))


def kmer_features(reads: DataFrame, k: int) -> DataFrame:
    """``read_id, kmer, n``: k-mers of A, C, G, T and how often each read has them."""
    return kmer_codes(reads, k).select("read_id", kmer_text(F.col("code"), k).alias("kmer"), "n")


def hashed_features(reads: DataFrame, k: int, size: int, key: str = "read_id", keep: Sequence[str] = ()) -> DataFrame:
    """``key, *keep, features``: sparse vectors of each read's k-mer shares, both strands folded, hashed to ``size`` places.

    k-mers up to ``DENSE`` have a table of their places, so a read's vector is made where the read is
    and no count is shuffled; longer ones go through the long table of counts, and keys must be
    unique.  Reads without a k-mer have no row.
    """
    dense = _dense_shares(reads, k, size, key, keep) if k <= DENSE else _shuffled_shares(reads, k, size, key, keep)
    return _vectors(dense.select(key, *keep, "dense"), size)


def _vectors(rows: DataFrame, size: int) -> DataFrame:
    """``dense`` as the vector ``features``, kept sparse by the assembler where that is smaller."""
    vectors = rows.select(*(c for c in rows.columns if c != "dense"), array_to_vector("dense").alias("__v"))
    known = VectorSizeHint(inputCol="__v", size=size, handleInvalid="optimistic").transform(vectors)  # else the first row is computed to learn it
    return VectorAssembler(inputCols=["__v"], outputCol="features").transform(known).drop("__v")


def _place(size: int) -> Column:
    return F.pmod(F.xxhash64("code"), F.lit(size)).cast("int").alias("place")


def _places(spark: SparkSession, k: int, size: int) -> np.ndarray:
    """The place of each code."""
    table = spark.range(4**k).withColumnRenamed("id", "code").select("code", _place(size)).collect()  # 4 ** DENSE at most
    return np.array([r["place"] for r in sorted(table)])


def _dense_shares(reads: DataFrame, k: int, size: int, key: str, keep: Sequence[str]) -> DataFrame:
    """``key, *keep, dense`` by blocks of sequences, each with at most ``PIECE`` letters looked at together."""
    places = _places(reads.sparkSession, k, size)
    letter = _letter_codes()
    source = reads.where("seq is not null").select(key, *keep, F.col("seq").cast("binary").alias("seq"))
    fields = list(to_arrow_schema(source.schema))[:-1]
    schema = pa.schema([*fields, ("dense", pa.list_(pa.float64()))])
    step = max(1, (1 << 20) // size)

    def shares(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts by row and place, and each row's k-mers."""
        letters = letter[np.frombuffer(b"".join(seqs.to_pylist()), np.uint8)]
        edge = np.concatenate([[0], np.cumsum(pc.binary_length(seqs).to_numpy(zero_copy_only=False))])
        cells = np.zeros((len(seqs), size))
        for at in range(0, len(letters) - k + 1, PIECE):
            code, good = code_windows(letters[at : at + PIECE + k - 1], k, True)
            start = at + np.arange(len(code))
            row = np.searchsorted(edge, start, "right") - 1
            good &= start + k <= edge[row + 1]
            first, last = row[0], row[-1] + 1
            own = (row[good] - first) * size + places[code[good]]
            cells[first:last] += np.bincount(own, minlength=(last - first) * size).reshape(-1, size)
        return cells, cells.sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cells, total = shares(part.column(len(fields)))
                some = np.flatnonzero(total)
                flat = (cells[some] / total[some, None]).ravel()
                dense = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(flat))
                own = part.take(pa.array(some)).columns[: len(fields)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, fields, strict=True)), dense], schema=schema)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{ddl}, dense array<double>")


def _shuffled_shares(reads: DataFrame, k: int, size: int, key: str, keep: Sequence[str]) -> DataFrame:
    """As ``_dense_shares``: codes that share a place are added up, and a read's places, ``size`` at most, are collected."""
    cells = kmer_codes(reads, k, folded=True, key=key).groupBy(key, _place(size)).agg(F.sum("n").cast("double").alias("n"))
    rows = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("cells"), F.sum("n").alias("total"))
    of = rows.select(key, F.col("cells.place").alias("places"), F.transform("cells", lambda c: c["n"] / F.col("total")).alias("shares"))
    first = to_arrow_schema(of.schema).field(0)
    schema = pa.schema([first, ("dense", pa.list_(pa.float64()))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // size)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                places = part.column("places")
                cells = np.zeros((part.num_rows, size))
                row = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                cells[row, places.flatten().to_numpy()] = part.column("shares").flatten().to_numpy()
                dense = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(first.type), dense], schema=schema)

    dense = of.mapInArrow(spread, f"{key} {of.schema[0].dataType.simpleString()}, dense array<double>")
    return dense.join(reads.select(key, *keep), key) if keep else dense


def _vector_array(cells: np.ndarray, kind: pa.StructType) -> pa.StructArray:
    """Rows as ML vectors, sparse where that is smaller, by the rule of ``Vector.compressed``."""
    n, size = cells.shape
    sparse = 1.5 * (np.count_nonzero(cells, axis=1) + 1) < size
    held = (cells != 0) | ~sparse[:, None]
    row, column = np.nonzero(held)
    edges = lambda count: pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    indices = pa.ListArray.from_arrays(edges(held.sum(1) * sparse), pa.array(column[sparse[row]].astype(np.int32)), mask=pa.array(~sparse))
    parts = {
        "type": pa.array((~sparse).astype(np.int8)), "size": pa.array(np.full(n, size, np.int32), mask=~sparse),
        "indices": indices, "values": pa.ListArray.from_arrays(edges(held.sum(1)), pa.array(cells[held])),
    }
    return pa.StructArray.from_arrays([parts[f.name].cast(f.type) for f in kind], fields=list(kind))


#: Windows that are counted together; a piece's are in any case.
WINDOWS = 2048


def window_shares(contigs: DataFrame, k: int, size: int, length: int, shift: int, keep: Sequence[str] = ()) -> DataFrame:
    """``contig, *keep, frag_id, features``: vectors as of ``hashed_features`` for the windows of ``fragment``.

    k-mers, of ``DENSE`` letters at most, are coded once along each piece of a contig, and a window's counts are
    the difference of two places, so windows that overlap are never spelled out.  Windows without a k-mer have no row.
    """
    if not 1 <= k <= DENSE:
        raise ValueError(f"k is from 1 to {DENSE}")
    places = _places(contigs.sparkSession, k, size)
    used, column = np.unique(places, return_inverse=True)  # only these are counted
    together = max(1, min(WINDOWS, (1 << 20) // size))
    letter, width = _letter_codes(), len(used)
    source = _pieces(contigs, length, shift, keep).where("piece is not null").drop("genome")
    n = 1 + len(keep)
    fields = list(to_arrow_schema(source.schema))[:n]
    out = StructType([*source.schema[:n].fields, StructField("frag_id", LongType()), StructField("features", VectorUDT())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = (as_long(batch, "last") - as_long(batch, "first") + 1).cumsum()
            at = 0
            while at < batch.num_rows:
                to = max(int(np.searchsorted(windows, (windows[at - 1] if at else 0) + together, "right")), at + 1)
                yield counted(batch.slice(at, to - at))
                at = to

    def as_long(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters = letter[np.frombuffer(b"".join(batch.column("piece").to_pylist()), np.uint8)]
        sizes = pc.binary_length(batch.column("piece")).to_numpy(zero_copy_only=False).astype(np.int64)
        lp, low, first, last = (as_long(batch, c) for c in ("lp", "low", "first", "last"))
        many = last - first + 1
        row = np.repeat(np.arange(len(many)), many)
        frag = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - first, many)
        start = frag * shift - lp[row] - low[row]
        edge = (np.cumsum(sizes) - sizes)[row]
        a, b = (np.clip(x, 0, sizes[row]) for x in (start, start + length))
        ends = edge + a, edge + np.maximum(b - k + 1, a)  # k-mers begin from the first and before the last
        bounds, at = np.unique(np.concatenate(ends), return_inverse=True)
        code, good = code_windows(letters, k, True)
        marks = np.zeros(len(letters) + 1, np.int64)
        marks[bounds] = 1
        part = np.cumsum(marks)[: len(code)]  # bounds at or before a place
        here = np.bincount(part[good] * width + column[code[good]], minlength=(len(bounds) + 1) * width).reshape(-1, width)
        before = np.cumsum(here[:-1], axis=0)
        cells = before[at[len(row) :]] - before[at[: len(row)]]
        total = cells.sum(1)
        some = np.flatnonzero(total)
        wide = np.zeros((len(some), size))
        wide[:, used] = cells[some] / total[some, None]
        own = [batch.column(i).take(pa.array(row[some])).cast(f.type) for i, f in enumerate(fields)]
        return pa.RecordBatch.from_arrays([*own, pa.array(frag[some]), _vector_array(wide, schema.field("features").type)], schema=schema)

    return source.mapInArrow(run, out)


def label_features(features: DataFrame, labels: DataFrame, accession: str) -> DataFrame:
    """Features with the ``label`` of their accession, null where it has none."""
    return features.join(labels.select(accession, "label"), accession, "left")


def train_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 20, seed: int = 1) -> PipelineModel:
    """A forest of ``features``; one that is a vector is taken as it is."""
    ready = len(features) == 1 and isinstance(df.schema[features[0]].dataType, VectorUDT)
    forest = RandomForestClassifier(labelCol=label, featuresCol=features[0] if ready else "__x", numTrees=trees, seed=seed)
    return Pipeline(stages=[forest] if ready else [VectorAssembler(inputCols=features, outputCol="__x"), forest]).fit(df)


def predict_forest(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("call"))


def forest_by_fold(df: DataFrame, features: list[str], k: int, *keep: str) -> DataFrame:
    """Each fold ``1..k`` predicted by a forest of the others; fold 0 (test) takes no part."""
    out = None
    for i in range(1, k + 1):
        model = train_forest(df.where((F.col("fold") != 0) & (F.col("fold") != i)), features)
        own = predict_forest(model, df.where(F.col("fold") == i), *keep, "fold")
        out = own if out is None else out.unionByName(own)
    return out
