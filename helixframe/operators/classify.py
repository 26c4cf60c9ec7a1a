"""Scores to calls: thresholds with a band of confidence, classes, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dealt


def classify(p: Column, t: float, conf: float | None = None) -> Column:
    """pos / neg / undef.  With ``conf`` both bounds are strict; without it neg is ``<= t``."""
    d = 0.0 if conf is None else abs(conf - t)
    low = p <= t if conf is None else p < t - d
    return F.when(p > t + d, "pos").when(low, "neg").otherwise("undef")


def classify_multi(p: Column, conf: float | None = None) -> Column:
    """First class of the highest score; null where that is not above ``conf``."""
    best = F.array_position(p, F.array_max(p)).cast("int") - 1
    return best if conf is None else F.when(F.array_max(p) > conf, best)


def route(df: DataFrame, called: Column, positive: list[int]) -> DataFrame:
    """Adds ``route``, by which one write with ``partitionBy`` splits the rows in three."""
    return df.withColumn(
        "route", F.when(called.isNull(), "undefined").when(called.isin(positive), "positive").otherwise("negative")
    )


def call_pairs(first: DataFrame, second: DataFrame, t: float, conf: float | None = None) -> DataFrame:
    """Both mates get the call of their mean score: ``read_id, mate, p, call``."""
    both = first.select("read_id", F.col("p").alias("p1")).join(second.select("read_id", F.col("p").alias("p2")), "read_id")
    called = both.withColumn("p", (F.col("p1") + F.col("p2")) / 2).withColumn("call", classify(F.col("p"), t, conf))
    return called.select("read_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"), "p", "call")


def attach_std(routed: DataFrame, stds: DataFrame) -> DataFrame:
    return routed.join(stds, "read_id", "left")


def attach_scores(reads: DataFrame, scores: DataFrame, on: str = "read_id") -> DataFrame:
    return reads.join(scores, on)


def unmatched(reads: DataFrame, scores: DataFrame, on: str = "read_id") -> DataFrame:
    """Keys that only one side has, with the side that lacks them."""
    reads, scores = dealt(reads.select(on), on), dealt(scores.select(on), on)
    no_score = reads.join(scores, on, "left_anti").withColumn("missing", F.lit("score"))
    no_read = scores.join(reads, on, "left_anti").withColumn("missing", F.lit("read"))
    return no_score.unionByName(no_read)
