"""Intermediate tables in the cluster's shared folder, and ranges of an order over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; one of our own only where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read again as often as needed, computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df`` by hash of ``by`` in ``spark.sql.shuffle.partitions`` parts, all of which stay.

    Adaptive plans join parts by their compressed size, which says little where keys compress well or
    a join multiplies rows: one task would then sort, or write, nearly the whole table.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the keys come once, from ``a``."""
    named = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.lit(True))
    return a.join(named, on, how).drop(*(f"__{k}" for k in keys))


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` stored with ``__range``: each group's rows in contiguous ranges of ``order``.

    Bounds are sampled over all rows, so a large group spreads over many ranges and small ones
    share one.  Rows of equal group and order are in one range.  Later ranges have larger numbers.
    """
    if not by and not order:
        raise ValueError("an order is needed")
    parted = df.repartitionByRange(*(F.asc(k) for k in by), *order)
    return stored(parted.withColumn("__range", F.spark_partition_id()), "ranges")


_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}
_TIE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def _spread(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of rows by group and range, those of groups in several ranges, for every task.

    Ranges are contiguous, so a range has two such groups at most, its first and its last: the rows
    are no more than twice the ranges, whatever the table.
    """
    ranges = F.count("*").over(Window.partitionBy(*by))
    return totals.withColumn("__ranges", ranges).where("__ranges > 1").drop("__ranges")


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], past: bool = False, whole: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """Adds running aggregates of a ``ranged`` table: within ranges, and over earlier ranges' totals.

    Each of ``values`` is a kind (``sum``, ``max`` or ``min``) and a column, taken up to the row, or
    only over the rows before it (``past``).  ``whole`` adds ``<name>_all`` over the group.
    """
    keys = [*by, "__range"]
    part = Window.partitionBy(*keys)
    inside = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if past else 0)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = _spread(df.groupBy(*keys).agg(*(_TOTAL[k](c).alias(f"__{n}") for n, (k, c) in values.items())), by)
    every = [_TOTAL[k](f"__{n}").over(Window.partitionBy(*by)).alias(f"__{n}_all") for n, (k, _) in values.items()] if whole else []
    before = totals.select(*keys, *(_TOTAL[k](f"__{n}").over(earlier).alias(f"__{n}") for n, (k, _) in values.items()), *every)
    local = {n: _TOTAL[k](c).over(inside) for n, (k, c) in values.items()}
    local |= {f"{n}_all": _TOTAL[k](c).over(part) for n, (k, c) in values.items()} if whole else {}
    tied = same(df.withColumns(local), F.broadcast(before), keys, "left")
    ties = {n: _TIE[k](F.col(n), F.col(f"__{n}")) for n, (k, _) in values.items()}
    ties |= {f"{n}_all": F.coalesce(f"__{n}_all", f"{n}_all") for n in values} if whole else {}
    return tied.withColumns(ties).drop(*(f"__{n}" for n in values), *(f"__{n}_all" for n in values))


def neighbour(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, ahead: bool) -> DataFrame:
    """Adds the ``value`` of the next row (or the one before) of a ``ranged`` table, across ranges.

    ``name`` is a struct with ``value``, null only where there is no such row.
    """
    keys = [*by, "__range"]
    boxed = F.struct(F.col(value).alias("value"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    edge = F.min_by if ahead else F.max_by
    beyond = Window.partitionBy(*by).orderBy("__range")
    step = F.lead if ahead else F.lag
    edges = _spread(df.groupBy(*keys).agg(edge(boxed, F.struct(*order)).alias("__edge")), by)
    edges = edges.select(*keys, step("__edge").over(beyond).alias("__edge"))
    local = df.withColumn(name, step(boxed).over(inside))
    return same(local, F.broadcast(edges), keys, "left").withColumn(name, F.coalesce(name, "__edge")).drop("__edge")


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``name``, from 1: each group's rows in ``order``, numbered range by range."""
    return running(ranged(df, by, order), by, order, **{name: ("sum", F.lit(1).cast("long"))}).drop("__range")
