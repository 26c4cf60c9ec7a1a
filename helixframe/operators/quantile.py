"""Exact quantiles of groups of any size, by repeated narrowing of counted ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import same, stored

#: Equal parts that a range is counted in, and distinct values that are then ordered by themselves.
PARTS, FEW = 256, 4096


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], parts: int = PARTS, few: int = FEW) -> DataFrame:
    """``by`` and a column for each of ``quantiles`` (name to share), interpolated between neighbours.

    Distinct values are counted once and stored.  Each wanted rank of each group has a range of
    values that holds it, at first the group's least to greatest value.  A round counts the range in
    ``parts`` equal parts, goes on within the part that holds the rank, and shrinks it to the values
    that are there; ranks whose range has ``few`` distinct values or fewer are read off in order.  So
    no task holds a group.  Nulls take no part; a group of nulls alone has no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    counted = stored(counted, "values")
    groups = counted.groupBy(*by).agg(F.sum("__c").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__d"))
    place = lambda q: (F.col("__n") - 1) * F.lit(float(q))
    ends = [f(place(q)).cast("long") for q in quantiles.values() for f in (F.floor, F.ceil)]
    wanted = stored(groups.select(*by, F.explode(F.array_distinct(F.array(*ends))).alias("__k"), "__lo", "__hi", "__d", F.lit(0).cast("long").alias("__below")), "ranks")
    keys, found = [*by, "__k"], None

    def within(ranges: DataFrame) -> DataFrame:
        return same(counted, ranges, by).where("__v between __lo and __hi")

    while True:
        near = wanted.where(F.col("__d") <= few)
        up = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v")) + F.col("__below")
        read = within(near).withColumn("__up", up).where("__up > __k").groupBy(*keys).agg(F.min("__v").alias("__v"))
        found = read if found is None else found.unionByName(read)
        wide = wanted.where(F.col("__d") > few)
        if wide.isEmpty():
            break
        share = F.expr("try_divide(__v / 2 - __lo / 2, __hi / 2 - __lo / 2)")
        part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), F.lit(parts - 1)).cast("int")
        counts = within(wide).groupBy(*keys, "__below", part.alias("__part")).agg(
            F.sum("__c").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__d")
        )
        inside = Window.partitionBy(*keys).orderBy("__part")  # PARTS rows
        summed = counts.withColumn("__up", F.sum("__c").over(inside) + F.col("__below")).where("__up > __k")
        first = summed.groupBy(*keys).agg(F.min_by(F.struct("__lo", "__hi", "__d", (F.col("__up") - F.col("__c")).alias("__below")), "__part").alias("__x"))
        wanted = stored(first.select(*keys, "__x.*"), "ranks")
    found = stored(found, "found")
    out = groups.select(*by, "__n")
    for name, q in quantiles.items():
        for f, end in ((F.floor, "lo"), (F.ceil, "hi")):
            own = found.withColumnsRenamed({"__v": f"__{end}"})
            out = same(out.withColumn("__k", f(place(q)).cast("long")), own, keys).drop("__k")
        rest = place(q) - F.floor(place(q))
        out = out.withColumn(name, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * rest).drop("__lo", "__hi")
    return out.drop("__n")
