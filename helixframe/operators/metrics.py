"""Exact, tie-aware classification metrics.

Everything that needs an order works on the table of distinct scores with their counts, which is
grouped before any window runs over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantile import exact_quantiles
from .store import same, stored
from .windows import running_sums

EPS = 1e-7


def confusion(df: DataFrame, by: Sequence[str], positive: Column, truth: str = "label", *more: Column) -> DataFrame:
    """``tp, tn, fp, fn`` and the undefined rows of both classes; a null ``positive`` is undefined."""
    true = F.col(truth) == 1
    return df.groupBy(*by).agg(
        F.count_if(positive & true).alias("tp"), F.count_if(~positive & ~true).alias("tn"),
        F.count_if(positive & ~true).alias("fp"), F.count_if(~positive & true).alias("fn"),
        F.count_if(positive.isNull() & true).alias("undef_pos"), F.count_if(positive.isNull() & ~true).alias("undef_neg"), *more,
    )


def rates(counts: DataFrame) -> DataFrame:
    """Ratios of ``tp, tn, fp, fn``; null where a denominator is zero (1 under the root of MCC)."""
    div = lambda a, b: F.expr(f"try_divide(cast({a} as double), {b})")
    root = "sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn))"
    return counts.withColumns({
        "tpr": div("tp", "tp + fn"), "tnr": div("tn", "tn + fp"), "ppv": div("tp", "tp + fp"), "npv": div("tn", "tn + fn"),
        "fpr": div("fp", "tn + fp"), "fnr": div("fn", "tp + fn"), "fdr": div("fp", "tp + fp"),
        "acc": div("tp + tn", "tp + tn + fp + fn"), "f1": div("2 * tp", "2 * tp + fp + fn"),
        "mcc": F.expr(f"(cast(tp as double) * tn - cast(fp as double) * fn) / if({root} = 0, 1, {root})"),
        "dor": F.expr("try_divide(cast(tp as double) * tn, cast(fp as double) * fn)"),
    }).withColumn("informedness", F.col("tpr") + F.col("tnr") - 1)


def score_counts(df: DataFrame, by: Sequence[str], p: str = "p", truth: str = "label") -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )


def curve(df: DataFrame, by: Sequence[str], p: str = "p", truth: str = "label") -> DataFrame:
    """Cumulative positives and negatives at or above each distinct score, and the totals."""
    found = running_sums(score_counts(df, by, p, truth), by, p, {"tp": "pos", "fp": "neg"}, desc=True)
    return found.withColumnsRenamed({"tp_all": "p_all", "fp_all": "n_all"})


_PAIRS = "sum(pos * (n_all - fp) + pos * neg / 2) / nullif(max(p_all) * max(n_all), 0)"
_GAIN = "sum(pos * tp / (tp + fp)) / nullif(max(p_all), 0)"


def auroc(df: DataFrame, by: Sequence[str], p: str = "p", truth: str = "label") -> DataFrame:
    """Mann-Whitney area with half ties; null for a group of one class."""
    return curve(df, by, p, truth).groupBy(*by).agg(F.expr(_PAIRS).cast("double").alias("auroc"))


def average_precision(df: DataFrame, by: Sequence[str], p: str = "p", truth: str = "label") -> DataFrame:
    return curve(df, by, p, truth).groupBy(*by).agg(F.expr(_GAIN).cast("double").alias("aupr"))


def areas(df: DataFrame, by: Sequence[str], p: str = "p", truth: str = "label") -> DataFrame:
    """Both areas from one curve."""
    return curve(df, by, p, truth).groupBy(*by).agg(F.expr(_PAIRS).cast("double").alias("auroc"), F.expr(_GAIN).cast("double").alias("aupr"))


def best_thresholds(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """All scores that maximise Youden's J (``criterion`` j) or F1 (``criterion`` f1)."""
    points = curve(df, by).withColumns({
        "j": F.expr("round(tp / nullif(p_all, 0) - fp / nullif(n_all, 0), 12)"), "f1": F.expr("round(2 * tp / (tp + fp + p_all), 12)"),
    })
    long = stored(points.selectExpr(*by, "p", "stack(2, 'j', j, 'f1', f1) as (criterion, value)"), "points")
    best = long.groupBy(*by, "criterion").agg(F.max("value").alias("value"))
    return same(long, best, [*by, "criterion", "value"], "left_semi")


def _loss(p: str, truth: str) -> Column:
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - EPS)), F.lit(EPS))
    loss = F.when(F.col(truth) == 1, -F.ln(clipped)).otherwise(-F.ln(1 - clipped))
    return F.avg(F.when(F.col(p).isNotNull(), loss)).alias("log_loss")


def log_loss(df: DataFrame, by: Sequence[str], p: str = "p", truth: str = "label") -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(*by).agg(_loss(p, truth))


def performance(df: DataFrame, by: Sequence[str], t: float, conf: float | None = None) -> DataFrame:
    """One row of metrics for each group, all groups in one job.

    Matched metrics leave undefined rows out; ``total_*`` count them as wrong.
    """
    d = 0.0 if conf is None else abs(conf - t)
    low = F.col("p") <= t if conf is None else F.col("p") < t - d
    positive = F.when(F.col("p") > t + d, True).when(low, False)
    counted = rates(confusion(df, by, positive, "label", _loss("p", "label"))).withColumns({
        "total_acc": F.expr("(tp + tn) / (tp + tn + fp + fn + undef_pos + undef_neg)"),
        "total_tpr": F.expr("try_divide(tp, tp + fn + undef_pos)"), "total_tnr": F.expr("try_divide(tn, tn + fp + undef_neg)"),
        "prediction_rate": F.expr("(tp + tn + fp + fn) / (tp + tn + fp + fn + undef_pos + undef_neg)"),
    })
    return counted.join(areas(df, by), list(by), "left")


def one_vs_rest(df: DataFrame, key: str, p: str = "p", truth: str = "label") -> DataFrame:
    """``key, class, p, label``: each class of a score array against the others."""
    return df.select(key, F.col(truth).alias("__truth"), F.posexplode(p).alias("class", "p")).select(
        key, "class", "p", (F.col("__truth") == F.col("class")).cast("int").alias("label")
    )


#: From each class's called (tp + fp) and true (tp + fn) rows; null where one class has all of either.
_CALLED, _TRUE = "cast(tp + fp as double)", "cast(tp + fn as double)"
_MCC = (
    f"(sum(tp) * sum({_TRUE}) - sum({_CALLED} * {_TRUE})) / "
    f"nullif(sqrt((pow(sum({_TRUE}), 2) - sum(pow({_CALLED}, 2))) * (pow(sum({_TRUE}), 2) - sum(pow({_TRUE}, 2)))), 0)"
)


def _class_cells(df: DataFrame, conf: float | None = None) -> DataFrame:
    """``class, tp, fp, fn, rows, called`` of each class; rows whose best score is not above ``conf`` are not called."""
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    held = F.lit(True) if conf is None else F.array_max("p") > conf
    called = df.select("label", F.when(held, best).alias("best"), F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("class"))
    mine, true = F.col("best") == F.col("class"), F.col("label") == F.col("class")
    return called.groupBy("class").agg(
        F.count_if(mine & true).alias("tp"), F.count_if(mine & ~true).alias("fp"), F.count_if(~mine & true).alias("fn"),
        F.count("*").alias("rows"), F.count("best").alias("called"),
    )


def performance_multi(df: DataFrame, key: str) -> DataFrame:
    """Macro means of one-vs-rest precision, recall, AUROC and average precision, and multiclass MCC."""
    per_class = _class_cells(df).join(areas(one_vs_rest(df, key), ["class"]), "class")
    return per_class.agg(
        F.avg(F.expr("coalesce(try_divide(tp, tp + fp), 0)")).alias("precision"), F.avg(F.expr("coalesce(try_divide(tp, tp + fn), 0)")).alias("recall"),
        F.avg("auroc").alias("auroc"), F.avg("aupr").alias("aupr"), F.sum("tp").alias("correct"), F.expr(_MCC).alias("mcc"),
    )


def performance_target(df: DataFrame, key: str, target: int, conf: float | None = None) -> DataFrame:
    """One row for one class of score arrays: its precision, recall and average precision.

    Rows whose best score is not above ``conf`` are undefined: they are left out of all but the
    average precision, which ranks every row, and ``prediction_rate``, the share that is defined.
    ``acc`` and ``mcc`` are those of all classes over the defined rows.
    """
    cells = _class_cells(df, conf)
    every = cells.agg(F.expr("try_divide(sum(tp), max(called))").alias("acc"), F.expr(_MCC).alias("mcc"), F.expr("try_divide(max(called), max(rows))").alias("prediction_rate"))
    own = cells.where(F.col("class") == target).select(
        "class", "tp", "fp", "fn", F.expr("coalesce(try_divide(tp, tp + fp), 0)").alias("precision"), F.expr("coalesce(try_divide(tp, tp + fn), 0)").alias("recall")
    )
    rest = one_vs_rest(df, key).where(F.col("class") == target)
    return own.join(average_precision(rest, ["class"]), "class", "left").join(F.broadcast(every))


def mid_rank(by: Sequence[str], value: str) -> Column:
    """Mean rank of tied values within a group."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def pooling_agreement(pooled: DataFrame) -> DataFrame:
    """Spearman between the two poolings ``esz, sez`` of genomes, to 9 places; one row a genome is ranked."""
    known = pooled.where("esz is not null and sez is not null").select(F.round("esz", 9).alias("esz"), F.round("sez", 9).alias("sez"))
    ranked = known.select(mid_rank([], "esz").alias("ra"), mid_rank([], "sez").alias("rb"))
    return ranked.agg(F.count("*").alias("genomes"), F.corr("ra", "rb").alias("spearman"))


def compare_scores(df: DataFrame, by: Sequence[str], a: str, b: str, atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Two scores of each row: KS statistic, Spearman, differences and whether all are close.

    The rows are stored once.  One running sum over the distinct values of both scores gives the
    ranks of either and the steps between their distributions.
    """
    gap = F.abs(F.col(a) - F.col(b))
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = stored(known.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b"), gap.alias("__gap")), "scores")
    values = both.select(*by, F.expr("stack(2, 1, __a, 0, __b) as (first, v)")).groupBy(*by, "v").agg(F.sum("first").alias("na"), F.sum(1 - F.col("first")).alias("nb"))
    summed = stored(running_sums(values, by, "v", {"up_a": "na", "up_b": "nb"}), "steps")
    ra, rb = (summed.where(f"n{x} > 0").select(*by, F.col("v").alias(f"__{x}"), (F.col(f"up_{x}") - (F.col(f"n{x}") - 1) / 2).alias(f"r{x}")) for x in "ab")
    ranked = same(same(both, ra, [*by, "__a"]), rb, [*by, "__b"])
    gap = F.col("__gap")
    plain = ranked.groupBy(*by).agg(
        F.corr("ra", "rb").alias("spearman"), F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.stddev_pop(gap).alias("std_diff"),
        F.bool_and(gap <= atol + rtol * F.abs(F.col("__b"))).alias("all_close"),
    )
    step = F.abs(F.col("up_a") / F.col("up_a_all") - F.col("up_b") / F.col("up_b_all"))
    steps = summed.groupBy(*by).agg(F.max(step).alias("ks"))
    return same(same(plain, exact_quantiles(both, by, "__gap", {"median_diff": 0.5}), by), steps, by)
