"""Pooling of scores and summaries of reads, contigs, labels and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool_replicates(df: DataFrame, key: str = "read_id") -> DataFrame:
    return df.groupBy(key).agg(F.avg("p").alias("p"), F.stddev_pop("p").alias("p_std"), F.count("p").alias("replicates"))


def ensemble(df: DataFrame, key: str = "read_id") -> DataFrame:
    return df.groupBy(key).agg(F.avg("p").alias("p"), F.count("p").alias("models"))


def pool_genomes(df: DataFrame, t: float, conf: float | None = None, by: Sequence[str] = ("genome",)) -> DataFrame:
    """Mean score of each genome's reads, of confident ones only if ``conf`` is given."""
    p = F.col("p") if conf is None else F.when(F.abs(F.col("p") - t) > abs(conf - t), F.col("p"))
    return df.groupBy(*by).agg(F.avg(p).alias("score"), F.count(p).alias("used"), F.count("*").alias("reads"))


def compare_pooling(df: DataFrame) -> DataFrame:
    """Per genome: mean of sigmoids and sigmoid of the mean of ``z``."""
    sig = lambda z: 1 / (1 + F.exp(-z))
    return df.groupBy("genome").agg(F.avg(sig(F.col("z"))).alias("esz"), sig(F.avg("z")).alias("sez"))


def majority_vote(df: DataFrame, by: str, label: str) -> DataFrame:
    """Majority label, positive on ties; null if any label of the group is unknown."""
    yes = F.count_if(F.col(label) == 1) * 2 >= F.count("*")
    return df.groupBy(by).agg(F.when(~F.bool_or(F.col(label).isNull()), yes.cast("int")).alias("vote"))


def concordant(x: Column, y: Column) -> Column:
    return F.when(x.isNull(), y).when(y.isNull(), x).when(x == y, x)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (2 * F.col("n")))


def background(reads: DataFrame, length: int, by: Sequence[str] = ()) -> DataFrame:
    """Base shares over reads x positions; N and padding dilute them."""
    total = F.count("*") * length
    shares = [(F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b)))) / total).alias(b.lower()) for b in "ACGT"]
    return reads.groupBy(*by).agg(*shares, F.count("*").alias("reads")).withColumn("gc", (F.col("g") + F.col("c")) / (F.col("a") + F.col("c") + F.col("g") + F.col("t")))


def length_hist(df: DataFrame, length: Column, bins: int = 10, top: int = 8000) -> DataFrame:
    bin_of = F.width_bucket(length, F.lit(0), F.lit(top), F.lit(bins)).cast("int")
    return df.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


def read_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def genome_sizes(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("genome").agg(F.sum("len").alias("size")).withColumn("log_size", F.log10("size"))


def gene_stats(features: DataFrame) -> DataFrame:
    """Per contig: features, mean length, mean gap to the end before, names in order."""
    w = Window.partitionBy("contig").orderBy("start", "end", "type")
    gaps = features.withColumn("gap", F.col("start") - F.lag("end").over(w))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "type"))), lambda x: x["type"]), ",")
    return gaps.groupBy("contig").agg(
        F.count("*").alias("genes"), F.avg(F.col("end") - F.col("start")).alias("mean_len"), F.avg("gap").alias("mean_gap"), names.alias("names")
    )


def short_contig_share(contigs: DataFrame, limit: int = 20_000) -> DataFrame:
    short = F.sum(F.when(F.col("len") < limit, F.col("len")).otherwise(0))
    return contigs.groupBy("genome").agg((short / F.nullif(F.sum("len"), F.lit(0))).alias("share"))


def flag_counts(versions: dict[str, DataFrame], conditions: dict[str, str]) -> DataFrame:
    """One row for each version with the count of rows under each condition."""
    every = None
    for name, df in versions.items():
        own = df.withColumn("version", F.lit(name))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("version").agg(*(F.count_if(F.expr(c)).alias(k) for k, c in conditions.items()))


def venn_counts(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Sizes of all intersections: a flag for each set and the count of keys."""
    every = None
    for name, df in sets.items():
        own = df.select(key, F.lit(name).alias("__set"))
        every = own if every is None else every.unionByName(own)
    flags = every.groupBy(key).agg(*(F.bool_or(F.col("__set") == n).alias(n) for n in sets))
    return flags.groupBy(*sets).agg(F.count("*").alias("n"))


def average_runs(runs: DataFrame, by: Sequence[str], over: str, metrics: Sequence[str]) -> DataFrame:
    """The runs plus ``avg`` rows of the means over ``over``."""
    mean = runs.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics)).withColumn(over, F.lit("avg"))
    return runs.withColumn(over, F.col(over).cast("string")).select(*by, over, *metrics).unionByName(mean)


def percent_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*(F.bround(F.avg(m) * 100, 3).alias(m) for m in metrics))


def pivot_metric(runs: DataFrame, keys: Sequence[str], on: str, values: Sequence, metric: str) -> DataFrame:
    return runs.groupBy(*keys).pivot(on, list(values)).agg(F.first(F.round(metric, 3)))
