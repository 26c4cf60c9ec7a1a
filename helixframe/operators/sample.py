"""Repeatable sampling, splitting and quotas by hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import row_numbers, same, stored


def hash_order(key: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def species_folds(species: DataFrame, k: int, test: float, seed: int, label: str = "label", key: str = "species", pinned: Sequence = ()) -> DataFrame:
    """``fold`` of each species: 0 for test (a share of each label, rounded up), else 1 to ``k``.

    ``pinned`` species are test ones by hand and fill their label's share first.
    """
    by_hand = F.col(key).isin(list(pinned)) if pinned else F.lit(False)
    w = Window.partitionBy(label).orderBy(*([by_hand.desc()] if pinned else []), hash_order(key, seed))
    ranked = species.withColumns({"__r": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(label))})
    tested = ranked.withColumn("__t", F.ceil(F.col("__n") * test)).withColumn("__test", (F.col("__r") <= F.col("__t")) | by_hand)
    fold = F.ntile(k).over(Window.partitionBy(label, "__test").orderBy("__r"))
    return tested.withColumn("fold", F.when(F.col("__test"), 0).otherwise(fold)).drop("__r", "__n", "__t", "__test")


def fold_columns(folds: DataFrame, k: int) -> DataFrame:
    """``fold1`` to ``foldk``: what a row is in each fold's run, train, val or test."""
    part = lambda i: F.when(F.col("fold") == 0, "test").when(F.col("fold") == i, "val").otherwise("train")
    return folds.withColumns({f"fold{i}": part(i) for i in range(1, k + 1)})


def sample_one(df: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(hash_order(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def inherit_folds(assigned: Sequence[DataFrame], key: str = "species") -> DataFrame:
    """``key, fold``: the fold of the earliest set that has a species."""
    every = None
    for i, df in enumerate(assigned):
        own = df.select(key, "fold", F.lit(i).alias("priority"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.min_by("fold", F.struct("priority", "fold")).alias("fold"))


#: Hash digits told apart in one pass over the rows, and rows that are then picked out by themselves.
DIGITS, FEW = 3, 4096


def first_by_hash(df: DataFrame, k: int, seed: int | str, key: str, few: int = FEW) -> DataFrame:
    """``df`` stored, with ``__in`` for exactly ``k`` rows: the first in hash order of ``key``.

    The place of the kth row is found digit by digit: each pass counts the rows under every value of
    the next ``DIGITS`` hash digits and goes on within the one that holds it.  The mark compares a
    row with that place, so nothing is sorted and rows stay where they are.  Rows of equal key are
    told apart by their place in the stored table.
    """
    row = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    kept = stored(df.withColumn("__o", F.concat(F.coalesce(hash_order(key, seed), F.lit("g" * 32)), row)), "hashed")
    prefix, left, cut = "", max(k, 0), None
    while left:
        under = kept.where(F.col("__o").startswith(prefix)) if prefix else kept
        counts = {r.d: r.n for r in under.groupBy(F.substring("__o", len(prefix) + 1, DIGITS).alias("d")).agg(F.count("*").alias("n")).collect()}  # 16 ** DIGITS rows
        if left >= sum(counts.values()):
            cut = None if not prefix else prefix + "~"
            break
        for d in sorted(counts):
            if left <= counts[d]:
                prefix += d
                break
            left -= counts[d]
        if counts[d] <= few:
            near = kept.where(F.col("__o").startswith(prefix)).select("__o").orderBy("__o").limit(left).collect()  # few rows
            cut = near[-1][0]
            break
    inside = F.lit(k > 0) if cut is None else F.col("__o") <= cut
    return kept.withColumn("__in", inside).drop("__o")


def sample_k(df: DataFrame, k: int, seed: int, key: str = "read_id") -> DataFrame:
    """Exactly ``k`` rows; tables that share keys give the same ones for the same seed."""
    return first_by_hash(df, k, seed, key).where("__in").drop("__in")


def shuffle(df: DataFrame, seed: int, within: Sequence[str], key: str) -> DataFrame:
    """A new ordinal within each group, in hash order; a group's rows are numbered by ranges of hashes."""
    hashed = df.withColumn("__h", hash_order(key, seed))
    return row_numbers(hashed, within, ["__h", key], "ordinal").drop("__h")


def shift_dataset(train: DataFrame, test: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Equal samples of both, labelled 0 and 1, the first 80 % of each for training."""
    parts = []
    for label, df in enumerate((train, test)):
        own = sample_k(df, n, seed, key)
        marked = first_by_hash(own, -(-own.count() * 4 // 5), seed + 1, key)
        parts.append(marked.withColumns({"label": F.lit(label), "part": F.when(F.col("__in"), "train").otherwise("val")}).drop("__in"))
    return parts[0].unionByName(parts[1])


def read_quota(genomes: DataFrame, total: int, mode: str, by: Sequence[str], paired: bool = False) -> DataFrame:
    """Reads of each genome: by ``size``, ``equal`` or by ``coverage`` of ``total`` bases a read."""
    w = Window.partitionBy(*by)
    share = {
        "size": F.ceil(F.col("size") / F.sum("size").over(w) * total),
        "equal": F.bround(F.lit(total) / F.count("*").over(w), 0),
        "coverage": F.ceil(F.col("size") / total),
    }[mode]
    return genomes.withColumn("reads", F.greatest(share.cast("long"), F.lit(2 if paired else 1).cast("long")))


def balanced_quota(genomes: DataFrame, total: int, mode: str, label: str, within: Sequence[str] = (), paired: bool = False) -> DataFrame:
    """``read_quota`` with half of ``total`` for each of two labels, in each subset ``within``."""
    return read_quota(genomes, total // 2, mode, [*within, label], paired)


def fragment_params(genomes: DataFrame, mean: int = 600, std: int = 60, length: int = 250) -> DataFrame:
    size = F.col("size")
    return genomes.withColumns({
        "frag_mean": F.least(F.lit(mean).cast("long"), size), "frag_std": F.when(size < mean + 3 * std, 0).otherwise(std), "read_len": F.least(F.lit(length).cast("long"), size),
    })


def clean_contigs(contigs: DataFrame, min_len: int) -> DataFrame:
    """Contigs above ``min_len``; the longest of a genome that has none (first on ties).

    A genome's contigs meet in an aggregate only: it gives the one contig to keep, if any.
    """
    best = contigs.groupBy("genome").agg(F.max("len").alias("__m"), F.min_by("contig", F.struct(-F.col("len"), F.col("contig"))).alias("__c"))
    sole = best.where(F.col("__m") <= min_len).select("genome", F.col("__c").alias("contig"))
    short = same(contigs.where(F.col("len") <= min_len), sole, ["genome", "contig"], "left_semi")
    return contigs.where(F.col("len") > min_len).unionByName(short)
