"""Dataset assembly: labelled unions, set operations, host levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import revcomp


def assemble(classes: Sequence[DataFrame], augment_rc: bool = False, length: int | None = None) -> DataFrame:
    """Class tables as one labelled set; ``augment_rc`` adds each read's reverse complement."""
    every = reduce(DataFrame.unionByName, [df.withColumn("label", F.lit(i)) for i, df in enumerate(classes)])
    every = every.withColumn("rc", F.lit(False))
    return every.unionByName(every.withColumns({"seq": revcomp(F.col("seq"), length), "rc": F.lit(True)})) if augment_rc else every


def merge_labelled(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("label", F.col("label") + 2 * i) for i, df in enumerate(sets)])


def union_fill(a: DataFrame, b: DataFrame, strict_left: bool = False) -> DataFrame:
    """Union with missing columns null; ``strict_left`` drops columns that only ``b`` has."""
    if strict_left:
        b = b.select(*(c for c in b.columns if c in a.columns))
    return a.unionByName(b, allowMissingColumns=True)


def stack_sources(tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``name, source`` with sources numbered from 0."""
    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias("name"), F.lit(i).alias("source")) for i, (df, c) in enumerate(tables)])


def species_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``op, key`` of the union, intersection and both differences, from one grouping."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s")))
    sides = both.groupBy(key).agg(F.bool_or(F.col("s") == 1).alias("a"), F.bool_or(F.col("s") == 2).alias("b"))
    ops = F.array_compact(F.array(F.lit("union"), F.when(F.col("a") & F.col("b"), "intersect"), F.when(~F.col("b"), "a_only"), F.when(~F.col("a"), "b_only")))
    return sides.select(F.explode(ops).alias("op"), key)


def host_partition(df: DataFrame, key: str, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """Innermost level of each key: ``levels`` are (name, condition) from the inside out."""
    flags = df.groupBy(key).agg(*(F.bool_or(F.expr(c)).alias(n) for n, c in levels))
    level = F.coalesce(*(F.when(F.col(n), F.lit(n)) for n, _ in levels), F.lit("other"))
    return flags.select(key, level.alias("level"))


def expand_labels(species: DataFrame, n: str = "n_reads") -> DataFrame:
    return species.where(F.col(n) > 0).select("label", "species", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias("i"))


def normalise_runs(runs: DataFrame, name: str = "file") -> DataFrame:
    """Attributes of runs from their file names: read lengths, network, data set."""
    return runs.withColumns({
        "lengths": F.array_join(F.regexp_extract_all(name, F.lit(r"(\d+-*\d*bp)"), 1), "_"),
        "network": F.nullif(F.regexp_extract(name, "(cnn|lstm|res18)", 1), F.lit("")), "dataset": F.nullif(F.regexp_extract(name, "(img|vhdb)", 1), F.lit("")),
    })
