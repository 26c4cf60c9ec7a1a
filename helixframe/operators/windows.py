"""Window operators: offsets, best and latest rows, ranks, crossings, cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import ranged, row_numbers, running


def first_row(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key by an explicit order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def block_offsets(species: DataFrame) -> DataFrame:
    """Start and end of each species' block of reads, in label and row order.

    One row a species goes through one task; reads do not.
    """
    w = Window.orderBy("label", "seq")
    end = F.sum("n_reads").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return species.withColumn("end", end).withColumn("start", F.col("end") - F.col("n_reads"))


def keep_latest(df: DataFrame, key: str, date: str, row: str) -> DataFrame:
    return first_row(df, [key], [F.desc_nulls_last(date), F.desc(row)])


def best_row(df: DataFrame, key: str, paired: str, level: str, levels: Sequence[str], date: str, row: str) -> DataFrame:
    """Best by paired status, place in ``levels``, then earliest date."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(level)), F.lit(0)), F.lit(len(levels) + 1))
    return first_row(df, [key], [F.desc(paired), rank, F.asc(date), F.asc(row)])


def best_sample(df: DataFrame, key: str, level: Column, row: str, seed: str) -> DataFrame:
    """One row of each key's best level, drawn by hash order."""
    return first_row(df.withColumn("__l", level), [key], ["__l", F.md5(F.concat(F.col(row).cast("string"), F.lit("|" + seed))), row]).drop("__l")


def factor_code(df: DataFrame, name: str, null_zero: bool) -> DataFrame:
    """Dense rank of a name from 0, or from 1 with 0 for null.

    Codes number the distinct names by ranges of names, so no task sees all of them.
    """
    distinct = df.select(name).where(F.col(name).isNotNull()).distinct()
    codes = row_numbers(distinct, [], [name], "code").withColumn("code", F.col("code") - (0 if null_zero else 1))
    out = df.join(codes, name, "left")
    return out.withColumn("code", F.coalesce("code", F.lit(0))) if null_zero else out


def threshold_cross(cells: DataFrame, by: Sequence[str], x: str, y: str, value: str, threshold: Column) -> DataFrame:
    """Cells where a value passes the threshold against the cell before, along either axis."""
    up = F.col(value) >= threshold
    last = lambda a, b: F.lag(F.coalesce(up, F.lit(False))).over(Window.partitionBy(*by, a).orderBy(b))
    return cells.withColumns({"cross_x": up & ~F.coalesce(last(y, x), F.lit(False)), "cross_y": up & ~F.coalesce(last(x, y), F.lit(False))})


def threshold_lines(cells: DataFrame, by: Sequence[str], x: str, y: str, value: str, own: Column) -> DataFrame:
    """Cells where a value passes its run's own threshold, up or down, against the cell before on either axis.

    The threshold of a run (``by``) is the value of the cell that ``own`` marks (the greatest, if it
    marks several); a cell without a known cell before it, and a run without a threshold, cross nothing.
    """
    marked = cells.groupBy(*by).agg(F.max(F.when(own, F.col(value))).alias("threshold"))
    held = cells.join(marked, list(by)).withColumn("__up", F.col(value) >= F.col("threshold"))
    last = lambda along, across: F.lag("__up").over(Window.partitionBy(*by, across).orderBy(along))
    crossed = {f"cross_{n}": F.coalesce(F.col("__up") != last(a, b), F.lit(False)) for n, a, b in (("x", x, y), ("y", y, x))}
    return held.withColumns(crossed).drop("__up")


def paired_gain(runs: DataFrame, by: Sequence[str], kind: str, paired: str, single: str, metric: str) -> DataFrame:
    pick = lambda v: F.max(F.when(F.col(kind) == v, F.col(metric)))
    return runs.groupBy(*by).agg((pick(paired) - pick(single)).alias("gain"))


def envelope(runs: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Best runs of each group, ties kept."""
    best = F.max(metric).over(Window.partitionBy(*by))
    return runs.withColumn("__b", best).where(F.col("__b") == F.col(metric)).drop("__b")


def seq_cycles(runs: DataFrame, by: Sequence[str], len1: str, len2: str, gap: Column, size: int) -> DataFrame:
    """Cycle ``len1 + len2 + gap`` for groups of exactly ``size`` rows."""
    n = F.count("*").over(Window.partitionBy(*by))
    return runs.withColumn("__n", n).where(F.col("__n") == size).withColumn("cycle", F.col(len1) + F.col(len2) + gap).drop("__n")


def running_sums(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], desc: bool = False) -> DataFrame:
    """Sums of columns up to each row by ``value``, and over the group as ``<name>_all``.

    ``sums`` maps new names to columns.  The rows are stored once in ranges of ``value``; a task sees
    one range of a group, and ranges are tied by their totals, of which there are as many as ranges.
    Values of any type with an order will do; they are distinct within a group.
    """
    order = F.desc if desc else F.asc
    parted = ranged(df, by, [value])
    if desc:
        parted = parted.withColumn("__range", -F.col("__range"))
    return running(parted, by, [order(value)], whole=True, **{n: ("sum", F.col(c)) for n, c in sums.items()}).drop("__range")
