"""Motif scans, matrices, comparisons and rankings over long tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.seq import revcomp
from .aggregate import background as _background  # noqa: F401
from .metrics import mid_rank
from .quantile import exact_quantiles

BASES = "ACGT"


def one_hot_weights(motif: str) -> np.ndarray:
    return np.array([[float(b == x) for x in BASES] for b in motif])


#: Letters that are scanned at a time.
SCAN = 1 << 17


#: Columns of a filter whose letters are looked up together.
JOINT = 6
#: Filters that are looked up together.
LOT = 64


def rounding_of(weights: np.ndarray, bias: float) -> float:
    """How far rounding may bring a sum over its bound: nothing where all sums are of whole 1024ths."""
    fine = np.append(weights.ravel(), bias) * 1024.0
    if np.all(fine == np.rint(fine)) and np.abs(fine).sum() < 2.0**52:
        return 0.0
    return 1e-9 * (abs(bias) + np.abs(weights).sum())


def joint_scores(weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each joint code of the first ``JOINT`` columns: its score, whether it may go on, and cells that bounds spare.

    Columns are added one after the other, so sums are those of a full scan to the last bit.
    """
    padded = np.vstack([weights, np.zeros(weights.shape[1])])
    best = np.append(np.cumsum(padded.max(0)[::-1])[::-1], 0.0)
    slack = rounding_of(weights, bias)
    q = min(weights.shape[1], JOINT)
    value, alive, looked = np.array([-bias]), np.ones(1, bool), np.zeros(1, np.int64)
    for j in range(q):
        alive = alive & (value + best[j] > -slack)
        looked = np.repeat(looked + alive, len(padded))
        value, alive = (value[:, None] + padded[:, j]).ravel(), np.repeat(alive, len(padded))
    return value, alive & (value + best[q] > -slack), q - looked


def joint_codes(letters: np.ndarray, q: int) -> np.ndarray:
    """The letters of ``q`` places from each place as one number; a byte holds those of three."""
    n, kinds = max(len(letters) - q + 1, 0), len(BASES) + 1
    codes = np.zeros(n, np.intp)
    for first in range(0, q, 3):
        few = np.zeros(n, np.int8)
        for j in range(first, min(first + 3, q)):
            few *= kinds
            few += letters[j : j + n]
        codes *= kinds ** min(3, q - first)
        codes += few
    return codes


def scan_letters(letters: np.ndarray, inside: np.ndarray, weights: np.ndarray, bias: float, codes: np.ndarray, joint: tuple[np.ndarray, np.ndarray, np.ndarray], may: np.ndarray, count: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Places with an activation above 0, the activations, and (``count``) cells that were not looked at.

    ``weights`` is (4, length) and ``inside`` tells where a motif may start.  A place can go once its
    score so far plus the best that the columns left can add is not above the bias.  The first columns
    are one lookup (``joint_scores`` by ``joint_codes``), which leaves the places ``may``; the others are
    added to all places at once until three quarters can go, from there only to those that are left, and
    fewer with each column.
    The sum's order is that of a full scan, and the bound has room for its rounding.
    """
    m, n = weights.shape[1], len(inside)
    padded = np.vstack([weights, np.zeros(m)])
    best = np.append(np.cumsum(padded.max(0)[::-1])[::-1], 0.0)
    slack = rounding_of(weights, bias)
    score, _, spared = joint
    codes = codes[:n]
    skipped = int(spared[codes].sum()) if count else 0
    at = may if 4 * len(may) < n else None
    value = score[codes if at is None else codes[at]]
    for j in range(min(m, JOINT), m):
        if at is None:
            left = (value + best[j] > -slack) & inside
            if 4 * np.count_nonzero(left) < n:
                at = np.flatnonzero(left)
                value = value[at]
        else:
            left = value + best[j] > -slack
            at, value = at[left], value[left]
        if at is None:
            value += padded[:, j][letters[j : j + n]]
        else:
            skipped += n - len(at)
            value += padded[:, j][letters[at + j]]
    hit = value > 0 if at is not None else (value > 0) & inside
    return (np.flatnonzero(hit) if at is None else at[hit]), value[hit], skipped


def motif_scan(reads: DataFrame, bank: dict[str, np.ndarray], bias: float, keys: Sequence[str], skipped: Accumulator | None = None) -> DataFrame:
    """Activations above 0 of each filter on both strands: ``keys, filter_id, strand, pos, activation``.

    ``bank`` maps filters to (length, 4) weights; positions count along the forward read.  Reads are
    scanned together in blocks of letters, each filter in turn with look-ahead bounds; ``skipped``
    counts the cells that bounds spared.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reads.select(*keys).schema)
    # other letters than ASCII have several bytes: each is one place
    seq = F.regexp_replace("seq", r"[^\x00-\x7F]", "N")
    source = reads.select(*keys, F.when(F.col("seq").rlike(r"[^\x00-\x7F]"), seq).otherwise(F.col("seq")).cast("binary").alias("seq"))
    kept = list(to_arrow_schema(reads.select(*keys).schema))
    schema = pa.schema([*kept, ("filter_id", pa.string()), ("strand", pa.string()), ("pos", pa.int64()), ("activation", pa.float64())])
    code = bytearray(b"\4" * 256)
    for i, base in enumerate(BASES):
        code[ord(base)] = i
    code = bytes(code)

    def blocks(seqs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, starts and ends of sequences in joined letters; a block closes once it has ``SCAN``."""
        sizes = np.nan_to_num(pc.binary_length(seqs).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = ends[first] - sizes[first]
            last = min(int(np.searchsorted(ends, before + SCAN)) + 1, len(sizes))
            raw = b"".join(x or b"" for x in seqs.slice(first, last - first).to_pylist())
            yield first, np.concatenate([[0], ends[first:last] - before]), np.frombuffer(raw.translate(code), np.int8)
            first = last

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [(name, strand, np.vstack([w if strand == "+" else w[::-1, ::-1]]).T) for name, w in bank.items() for strand in "+-"]
        joints = [joint_scores(weights, bias) for _, _, weights in filters]
        lots = []  # filters of equal length whose lookups are bits of one table
        for m in {weights.shape[1] for _, _, weights in filters}:
            own = [f for f, (_, _, weights) in enumerate(filters) if weights.shape[1] == m]
            for some in (own[i : i + LOT] for i in range(0, len(own), LOT)):
                bits = [np.uint64(1 << i) for i in range(len(some))]
                lots.append((m, list(zip(some, bits, strict=True)), sum(joints[f][1] * b for f, b in zip(some, bits, strict=True))))
        names, strands = pa.array([x[0] for x in filters], pa.string()), pa.array([x[1] for x in filters], pa.string())
        for batch in batches:
            for first, edge, letters in blocks(batch.column(len(kept))):
                end = np.repeat(edge[1:].astype(np.int64), np.diff(edge))
                place = np.arange(len(letters))
                found: list[tuple] = []
                codes = {q: joint_codes(letters, q) for q in {min(w.shape[1], JOINT) for _, _, w in filters}}
                for m, lot, table in lots:
                    n = max(len(letters) - m + 1, 0)
                    inside, own = place[:n] + m <= end[:n], codes[min(m, JOINT)]
                    bits = table[own[:n]]
                    some = np.flatnonzero((bits != 0) & inside)
                    bits = bits[some]
                    for f, bit in lot:
                        at, value, spared = scan_letters(letters, inside, filters[f][2], bias, own, joints[f], some[bits & bit != 0], skipped is not None)
                        if skipped is not None:
                            skipped.add(spared)
                        found.append((at, np.full(len(at), f), value))
                at, of, value = (np.concatenate(x) for x in zip(*found, strict=True))
                row = np.searchsorted(edge, at, "right") - 1
                own = [batch.column(i).take(pa.array(first + row)) for i in range(len(kept))]
                columns = [*(c.cast(f.type) for c, f in zip(own, kept, strict=True)), names.take(pa.array(of)), strands.take(pa.array(of)), pa.array(at - edge[row]), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return source.mapInArrow(scan, f"{fields}, filter_id string, strand string, pos long, activation double")


def center_weights(weights: DataFrame, bias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean-centre ``weights (filter_id, pos, base, w)`` by position; the means move to the bias."""
    mean = F.avg("w").over(Window.partitionBy("filter_id", "pos"))
    centred = weights.withColumn("w", F.col("w") - mean)
    moved = weights.groupBy("filter_id", "pos").agg(F.avg("w").alias("m")).groupBy("filter_id").agg(F.sum("m").alias("moved"))
    return centred, bias.join(moved, "filter_id").select("filter_id", (F.col("bias") + F.col("moved")).alias("bias"))


def motif_seqs(hits: DataFrame, reads: DataFrame, motif_len: int, on: Sequence[str]) -> DataFrame:
    """Sub-sequence of each hit, N beyond the read; reverse-strand hits reverse-complemented."""
    # cut first, then pad: the read itself is never copied for a hit
    before = F.greatest(F.lit(0), -F.col("pos")).cast("int")
    inside = F.substring("seq", (F.greatest(F.lit(0), F.col("pos")) + 1).cast("int"), F.greatest(F.lit(0), F.lit(motif_len) - before))
    cut = F.rpad(F.concat(F.repeat(F.lit("N"), before), inside), motif_len, "N")
    # dealt by key first: a sequence that is an expression would else be computed again for each hit
    both = hits.join(reads.select(*on, "seq").repartition(*on), list(on))
    return both.withColumn("motif", F.when(F.col("strand") == "-", revcomp(cut)).otherwise(cut)).drop("seq")


def easy_partials(seqs: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each base of a hit in its activation: ``w * activation / sum of w``."""
    each = seqs.select("filter_id", "contig", "pos", "strand", "activation", F.posexplode(F.split("motif", "")).alias("mpos", "base"))
    w = weights.withColumnRenamed("pos", "mpos")
    weighed = each.join(w, ["filter_id", "mpos", "base"])
    total = F.sum("w").over(Window.partitionBy("filter_id", "contig", "pos", "strand"))
    return weighed.withColumn("partial", F.col("w") * F.col("activation") / F.nullif(total, F.lit(0.0)))


def motif_matrix(seqs: DataFrame, weight: str | None = None) -> DataFrame:
    """``filter_id, pos, base, cnt``: letters at each place, each worth 1 or ``abs(weight)``."""
    each = seqs.select("filter_id", (F.abs(weight) if weight else F.lit(1.0)).alias("w"), F.posexplode(F.split("motif", "")).alias("pos", "base"))
    return each.where("base <> ''").groupBy("filter_id", "pos", "base").agg(F.sum("w").alias("cnt"))


def to_pwm(matrix: DataFrame, bg: dict[str, float]) -> DataFrame:
    """Adds ``prob`` with background pseudocounts and ``logodds``; all four bases get a row."""
    wide = matrix.groupBy("filter_id", "pos").agg(*(F.coalesce(F.sum(F.when(F.col("base") == b, F.col("cnt"))), F.lit(0.0)).alias(b) for b in bg))
    cells = F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("cnt"), F.lit(v).alias("bg")) for b, v in bg.items()))
    full = wide.select("filter_id", "pos", F.inline(cells))
    total = F.sum("cnt").over(Window.partitionBy("filter_id", "pos")) + sum(bg.values())
    return full.withColumn("prob", (F.col("cnt") + F.col("bg")) / total).withColumn("logodds", F.log2(F.col("prob") / F.col("bg")))


def motif_ic(pwm: DataFrame) -> DataFrame:
    """Mean information content over a motif's places."""
    return pwm.groupBy("filter_id").agg((F.sum(F.col("prob") * F.col("logodds")) / F.count_distinct("pos")).alias("ic"))


def compare_motifs(a: DataFrame, b: DataFrame, shift: int, min_overlap: int) -> DataFrame:
    """Pearson and Spearman of each pair of motifs ``(filter_id, pos, base, prob)`` at each offset."""
    x = a.select(F.col("filter_id").alias("a"), "pos", "base", F.col("prob").alias("pa"))
    x = x.withColumn("offset", F.explode(F.sequence(F.lit(-shift), F.lit(shift)))).withColumn("pos", F.col("pos") + F.col("offset"))
    y = b.select(F.col("filter_id").alias("b"), "pos", "base", F.col("prob").alias("pb"))
    key = ["a", "b", "offset"]
    both = x.join(y, ["pos", "base"])
    ranked = both.withColumns({"ra": mid_rank(key, "pa"), "rb": mid_rank(key, "pb")})
    found = ranked.groupBy(*key).agg(F.count("*").alias("cells"), F.corr("pa", "pb").alias("pearson"), F.corr("ra", "rb").alias("spearman"))
    return found.where(F.col("cells") >= min_overlap * 4)


def compare_both_strands(a: DataFrame, b: DataFrame, shift: int, min_overlap: int) -> DataFrame:
    """``compare_motifs`` with ``a`` as it is (strand ``+``) and reverse-complemented (``-``)."""
    last = F.max("pos").over(Window.partitionBy("filter_id"))
    turned = a.withColumns({"pos": last - F.col("pos"), "base": F.translate("base", "ACGT", "TGCA")})
    ways = [compare_motifs(x, b, shift, min_overlap).withColumn("strand", F.lit(s)) for x, s in ((a, "+"), (turned, "-"))]
    return ways[0].unionByName(ways[1])


def correlation_p(found: DataFrame, r: str = "pearson", n: str = "cells") -> DataFrame:
    """Adds the two-sided p of a correlation by Student's t (regularised incomplete beta)."""

    @F.pandas_udf("double")
    def p_of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p_value(x, int(k)) for x, k in zip(r, n, strict=True)], dtype=float)

    return found.withColumn("p", p_of(r, n))


def correlation_p_value(r: float, n: int) -> float:
    if r is None or r != r or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    # P(|T| > t) = I_{1 - r^2}(df / 2, 1 / 2); the integral over sin^(df-1) by Gauss-Legendre
    x, w = np.polynomial.legendre.leggauss(200)
    df, top = n - 2, np.arccos(abs(r))
    density = lambda t: np.sin(t) ** (df - 1)
    area = lambda hi: hi / 2 * float(w @ density(hi / 2 * (x + 1)))
    return area(top) / area(np.pi / 2)


def best_match(found: DataFrame) -> DataFrame:
    """Offset and strand of the smallest ``p`` (to 9 places) of each pair, the least shift on ties."""
    w = Window.partitionBy("a", "b").orderBy(F.asc_nulls_last(F.round("p", 9)), F.abs("offset"), "offset", "strand")
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def best_by_measure(found: DataFrame) -> DataFrame:
    """``a, b, measure, strand, offset, cells, r, p``: each measure's own best offset and strand."""
    out = None
    for measure in ("pearson", "spearman"):
        own = found.select("a", "b", "strand", "offset", "cells", F.lit(measure).alias("measure"), F.col(measure).alias("r"))
        best = best_match(correlation_p(own, "r"))
        out = best if out is None else out.unionByName(best)
    return out


def rank_filters(contribs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per filter: means with and without zeros, range, and how well a positive score tells class 1.

    ``contribs (filter_id, read_id, score)`` leaves zeros out; reads without a row count as zero,
    from totals, without being spelled out.
    """
    total = labels.agg(F.count("*").alias("reads"), F.count_if(F.col("label") == 1).alias("p_all"))
    seen = contribs.where("score <> 0").join(labels, "read_id").groupBy("filter_id").agg(
        F.count("*").alias("nonzero"), F.sum("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.count_if((F.col("score") > 0) & (F.col("label") == 1)).alias("up1"), F.count_if((F.col("score") > 0) & (F.col("label") != 1)).alias("up0"),
        F.count_if((F.col("score") < 0) & (F.col("label") == 1)).alias("down1"), F.count_if((F.col("score") < 0) & (F.col("label") != 1)).alias("down0"),
    )
    both = seen.crossJoin(F.broadcast(total)).withColumn("positive", F.col("s") >= 0)
    pick = lambda a, b: F.when(F.col("positive"), F.col(a)).otherwise(F.col(b))
    n_all = F.col("reads") - F.col("p_all")
    target, other = F.when(F.col("positive"), F.col("p_all")).otherwise(n_all), F.when(F.col("positive"), n_all).otherwise(F.col("p_all"))
    out = both.select(
        "filter_id", (F.col("s") / F.col("nonzero")).alias("mean_nonzero"), (F.col("s") / F.col("reads")).alias("mean"),
        F.when(F.col("nonzero") < F.col("reads"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(F.col("nonzero") < F.col("reads"), F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"),
        pick("up1", "down0").alias("tp"), pick("up0", "down1").alias("fp"), target.alias("__t"), other.alias("__o"), (F.col("nonzero") / F.col("reads")).alias("share"),
    )
    out = out.withColumns({"fn": F.col("__t") - F.col("tp"), "tn": F.col("__o") - F.col("fp")})
    return out.withColumns({
        "sensitivity": F.expr("try_divide(tp, __t)"), "specificity": F.expr("try_divide(tn, __o)"), "accuracy": F.expr("(tp + tn) / (__t + __o)"),
    }).drop("__t", "__o")


def score_distribution(cells: DataFrame, lo: float, hi: float, bins: int = 100) -> DataFrame:
    """Histogram of ``score`` for each filter and cell, on ``bins`` equal bins."""
    at = F.least(F.floor((F.col("score") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return cells.groupBy("filter_id", "cell", at.alias("bin")).agg(F.count("*").alias("n"))


def score_quartiles(cells: DataFrame) -> DataFrame:
    """``q25, q50, q75`` of the scores of each filter and cell."""
    return exact_quantiles(cells, ["filter_id", "cell"], "score", {f"q{int(q * 100)}": q for q in (0.25, 0.5, 0.75)})


def nt_logo_table(nuc: DataFrame, pseudo: float | dict[str, float] = 1.0, gain: float = 255.0, limits: tuple[float, float] | None = None) -> DataFrame:
    """Mean ``score`` by filter, place and base, and its ``level`` from 0 to 255.

    ``pseudo`` is one count for all bases or one for each; other letters are then left out.
    Levels run between ``limits`` where they are given, else by ``gain`` around the middle.
    """
    count = F.lit(pseudo)
    if isinstance(pseudo, dict):
        nuc = nuc.where(F.col("base").isin(list(pseudo)))
        count = F.create_map(*(F.lit(x) for pair in pseudo.items() for x in pair))[F.col("base")]
    means = nuc.groupBy("filter_id", "pos", "base").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    means = means.select("filter_id", "pos", "base", (F.col("s") / (F.col("n") + count)).alias("mean"))
    level = F.col("mean") * gain + 127.5 if limits is None else (F.col("mean") - limits[0]) / (limits[1] - limits[0]) * 255
    scaled = F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))
    return means.withColumn("level", F.floor(scaled).cast("int"))


def merge_strands(df: DataFrame, forward: str, reverse: str, how: str) -> DataFrame:
    a, b = F.coalesce(forward, F.lit(0.0)), F.coalesce(reverse, F.lit(0.0))
    merged = {"sum": a + b, "max": F.greatest(a, b), "product": a * b, "mean": (a + b) / 2}[how]
    return df.withColumn("activation", merged)


def top_hit(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Strongest hit of each read and filter: first place on ties, forward if it is no weaker."""
    w = Window.partitionBy(*by).orderBy(F.desc("activation"), "strand", "pos")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
