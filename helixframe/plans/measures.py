"""Queries of pooling and of classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import metrics as M
from ..operators.store import stored
from . import fixtures as X
from .sequences import _GC, _SOFT, _gc, _pairs, _reps, _softmaxed

T, CONF = X.T, X.CONF
BY = ["model", "genome"]
_W = X.with_tables
LEN = "(len - 1) % 8"


def _round(df, *keep):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" and c not in keep else c for c, t in df.dtypes))


def _runs(s, d):
    """Metric runs: mean scores by model, genome and read length."""
    return (
        X.scores(s, d).withColumn("length", (F.col("read_id") % 5 * 50 + 50).cast("int"))
        .groupBy("model", "genome", "length").agg(F.avg("p").alias("acc"), F.max("p").alias("top"), F.min("p").alias("low"))
    )


def _class_scores(s, d):
    """Rounded score vectors, stored: metrics read them once for each class and curve."""
    return stored(_softmaxed(s, d).withColumn("p", F.transform("p", lambda x: F.round(x, 9))), "class-scores")


_RUNS = _W("scores") + ", runs AS (SELECT model, genome, (read_id % 5 * 50 + 50)::INT AS length, avg(p) AS acc, max(p) AS top, min(p) AS low FROM scores GROUP BY ALL)"


def _hosts(s, d):
    return X.table(s, d, "orders").selectExpr("o_custkey", "o_orderstatus = 'F' as conf", "o_totalprice > 150000 as big", "o_orderpriority", "o_orderdate")


def _concordant(first, second):
    calls = [(F.col(c) > T).cast("int") for c in ("p", "q")]
    return first.join(second.withColumnRenamed("p", "q"), "read_id", "full").select("read_id", A.concordant(*calls).alias("call"))


FLAGS = {
    "n_all": "true", "n_conf": "conf", "n_big": "big", "n_both": "conf and big", "n_neither": "not conf and not big",
    "n_urgent": "o_orderpriority = '1-URGENT'", "n_urgent_conf": "conf and o_orderpriority = '1-URGENT'", "n_recent": "o_orderdate >= timestamp '1997-01-01'",
}

QUERIES = {
    "agg_replicates": lambda s, d: _round(A.pool_replicates(_reps(s, d))),
    "agg_ensemble": lambda s, d: _round(A.ensemble(X.scores(s, d))),
    "agg_genome": lambda s, d: _round(A.pool_genomes(X.scores(s, d), T, CONF, BY)),
    "agg_esz_sez_rho": lambda s, d: _round(M.pooling_agreement(A.compare_pooling(_gc(s, d).selectExpr("genome", "(p - 0.5) * 20 as z")))),
    "agg_esz_sez": lambda s, d: _round(A.compare_pooling(_gc(s, d).selectExpr("genome", "(p - 0.5) * 20 as z"))),
    "agg_vote": lambda s, d: A.majority_vote(_gc(s, d).selectExpr("contig", f"case when p > {T} then 1 when p <= {T} then 0 end as call"), "contig", "call"),
    "agg_concord": lambda s, d: _concordant(*_pairs(s, d)),
    "agg_confusion": lambda s, d: M.confusion(X.labelled(s, d), BY, F.col("p") > T),
    "agg_metrics": lambda s, d: _round(M.rates(M.confusion(X.labelled(s, d), BY, F.col("p") > T)).drop("undef_pos", "undef_neg")),
    "agg_perf": lambda s, d: _round(M.performance(X.labelled(s, d), ["model"], T, CONF)),
    "agg_perf_multi": lambda s, d: _round(M.performance_multi(_class_scores(s, d), "vec_id")),
    "agg_perf_target": lambda s, d: _round(M.performance_target(_class_scores(s, d), "vec_id", 3, 0.5)),
    "agg_gene_share": lambda s, d: _round(A.short_contig_share(X.contigs(s, d), 2000)),
    "m_logloss": lambda s, d: _round(M.log_loss(X.labelled(s, d), BY)),
    "m_auroc": lambda s, d: _round(M.auroc(X.labelled(s, d), BY)),
    "m_aupr": lambda s, d: _round(M.average_precision(X.labelled(s, d), BY)),
    "m_best_thr": lambda s, d: M.best_thresholds(X.labelled(s, d), ["model"]),
    "m_stability": lambda s, d: _round(M.compare_scores(_gc(s, d).join(X.scores(s, d).where("model = 'ag'").selectExpr("read_id", "p as q"), "read_id"), ["genome"], "p", "q")),
    "agg_classweight": lambda s, d: _round(A.class_weights(X.labels(s, d), "label4")),
    "agg_background": lambda s, d: _round(A.background(X.reads(s, d), 250, ["genome"])),
    "agg_reads_per": lambda s, d: A.length_hist(X.contigs(s, d), F.col("len")),
    "agg_genome_size": lambda s, d: _round(A.genome_sizes(X.contigs(s, d))),
    "agg_gene_stats": lambda s, d: _round(A.gene_stats(X.features(s, d))),
    "agg_flag_counts": lambda s, d: A.flag_counts({"old": _hosts(s, d).where("o_orderdate < timestamp '1996-01-01'"), "new": _hosts(s, d)}, FLAGS),
    "agg_venn": lambda s, d: A.venn_counts({k: X.table(s, d, "orders").where(c).select("o_custkey") for k, c in _SETS.items()}, "o_custkey"),
    "agg_runs": lambda s, d: _round(A.average_runs(_runs(s, d), ["model", "genome"], "length", ["acc", "top", "low"])),
    "agg_pct": lambda s, d: A.percent_summary(_runs(s, d).withColumn("acc", F.round("acc", 9)), ["model", "genome"], ["top", "low"]),
    "agg_pivot": lambda s, d: A.pivot_metric(_runs(s, d), ["model", "genome"], "length", [50, 100, 150, 200, 250], "top"),
}
_SETS = {"f": "o_orderstatus = 'F'", "o": "o_orderstatus = 'O'", "urgent": "o_orderpriority = '1-URGENT'", "big": "o_totalprice > 200000"}

_CURVE = """, sc AS (SELECT {by}, p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM {src} WHERE p IS NOT NULL GROUP BY ALL),
 cur AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p_all, sum(neg) OVER (PARTITION BY {by}) AS n_all FROM sc WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)),
 au AS (SELECT {by}, sum(pos * (n_all - fp) + pos * neg / 2) / nullif(max(p_all) * max(n_all), 0)::DOUBLE AS auroc, sum(pos * tp / (tp + fp)) / nullif(max(p_all), 0) AS aupr FROM cur GROUP BY ALL)"""


def _curve(by: str, src: str = "labelled") -> str:
    return _W("labelled") + _CURVE.format(by=by, src=src)


_CELLS = "count(*) FILTER ({pos} AND label = 1) AS tp, count(*) FILTER (NOT {pos} AND label <> 1) AS tn, count(*) FILTER ({pos} AND label <> 1) AS fp, count(*) FILTER (NOT {pos} AND label = 1) AS fn, count(*) FILTER ({pos} IS NULL AND label = 1) AS undef_pos, count(*) FILTER ({pos} IS NULL AND label <> 1) AS undef_neg"
_CONF = f"SELECT model, genome, {_CELLS.format(pos=f'(p > {T})')} FROM labelled GROUP BY ALL"
_RATIOS = {
    "tpr": "tp / nullif(tp + fn, 0)", "tnr": "tn / nullif(tn + fp, 0)", "ppv": "tp / nullif(tp + fp, 0)", "npv": "tn / nullif(tn + fn, 0)", "fpr": "fp / nullif(tn + fp, 0)",
    "fnr": "fn / nullif(tp + fn, 0)", "fdr": "fp / nullif(tp + fp, 0)", "acc": "(tp + tn) / nullif(tp + tn + fp + fn, 0)", "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
    "mcc": "(tp::DOUBLE * tn - fp::DOUBLE * fn) / coalesce(nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 1)",
    "dor": "tp::DOUBLE * tn / nullif(fp::DOUBLE * fn, 0)", "informedness": "tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1",
}
_ROUNDED = ", ".join(f"round({e}, 9) AS {k}" for k, e in _RATIOS.items())
_POS = f"(CASE WHEN p > {T} + {abs(CONF - T)}::DOUBLE THEN true WHEN p < {T} - {abs(CONF - T)}::DOUBLE THEN false END)"
_LOSS = "avg(CASE WHEN label = 1 THEN -ln(greatest(least(p, 1 - 1e-7), 1e-7)) ELSE -ln(1 - greatest(least(p, 1 - 1e-7), 1e-7)) END) FILTER (p IS NOT NULL)"
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("acc", "top", "low"))

SQL = {
    "agg_replicates": "SELECT user_id AS read_id, round(avg(value / 491.0::DOUBLE), 9) AS p, round(stddev_pop(value / 491.0::DOUBLE), 9) AS p_std, count(value) AS replicates FROM events GROUP BY 1",
    "agg_ensemble": _W("scores") + " SELECT read_id, round(avg(p), 9) AS p, count(p) AS models FROM scores GROUP BY 1",
    "agg_genome": _W("scores") + f" SELECT model, genome, round(avg(p) FILTER (abs(p - {T}) > {abs(CONF - T)}::DOUBLE), 9) AS score, count(p) FILTER (abs(p - {T}) > {abs(CONF - T)}::DOUBLE) AS used, count(*) AS reads FROM scores GROUP BY ALL",
    "agg_esz_sez_rho": _W("scores") + ", z AS (SELECT genome, (p - 0.5) * 20 AS z FROM scores WHERE model = 'gc'), m AS (SELECT genome, round(avg(1 / (1 + exp(-z))), 9) AS esz, round(1 / (1 + exp(-avg(z))), 9) AS sez FROM z GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY esz) + (count(*) OVER (PARTITION BY esz) - 1) / 2 AS ra, rank() OVER (ORDER BY sez) + (count(*) OVER (PARTITION BY sez) - 1) / 2 AS rb FROM m WHERE esz IS NOT NULL AND sez IS NOT NULL) SELECT count(*) AS genomes, round(corr(ra, rb), 9) AS spearman FROM r",
    "agg_esz_sez": _W("scores") + ", z AS (SELECT genome, (p - 0.5) * 20 AS z FROM scores WHERE model = 'gc') SELECT genome, round(avg(1 / (1 + exp(-z))), 9) AS esz, round(1 / (1 + exp(-avg(z))), 9) AS sez FROM z GROUP BY 1",
    "agg_vote": _W("scores") + f", k AS (SELECT contig, CASE WHEN p > {T} THEN 1 WHEN p <= {T} THEN 0 END AS c FROM scores WHERE model = 'gc') SELECT contig, CASE WHEN NOT bool_or(c IS NULL) THEN (count(*) FILTER (c = 1) * 2 >= count(*))::INT END AS vote FROM k GROUP BY 1",
    "agg_concord": _GC + f", x AS (SELECT read_id, (a.p > {T})::INT AS x, (b.p > {T})::INT AS y FROM gc a FULL JOIN (SELECT read_id - 1 AS read_id, p FROM gc) b USING (read_id)) SELECT read_id, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x WHEN x = y THEN x END AS call FROM x",
    "agg_confusion": _W("labelled") + " " + _CONF,
    "agg_metrics": _W("labelled") + f", c AS ({_CONF}) SELECT model, genome, tp, tn, fp, fn, {_ROUNDED} FROM c",
    "agg_perf": _curve("model") + f""", c AS (SELECT model, {_CELLS.format(pos=_POS)}, {_LOSS} AS ll FROM labelled GROUP BY ALL)
        SELECT model, tp, tn, fp, fn, undef_pos, undef_neg, {_ROUNDED}, round((tp + tn) / (tp + tn + fp + fn + undef_pos + undef_neg), 9) AS total_acc, round(tp / nullif(tp + fn + undef_pos, 0), 9) AS total_tpr,
        round(tn / nullif(tn + fp + undef_neg, 0), 9) AS total_tnr, round((tp + tn + fp + fn) / (tp + tn + fp + fn + undef_pos + undef_neg), 9) AS prediction_rate, round(ll, 9) AS log_loss, round(auroc, 9) AS auroc, round(aupr, 9) AS aupr FROM c JOIN au USING (model)""",
    "agg_perf_multi": f"WITH {_SOFT}, r AS (SELECT vec_id, label AS truth, list_position(list_transform(p, lambda x: round(x, 9)), list_max(list_transform(p, lambda x: round(x, 9)))) - 1 AS best, unnest(range(10)) AS class, unnest(list_transform(p, lambda x: round(x, 9))) AS p FROM soft), ovr AS (SELECT class, p, (truth = class)::INT AS label FROM r)"
    + _CURVE.format(by="class", src="ovr")
    + ", cells AS (SELECT class, count(*) FILTER (best = class AND truth = class) AS tp, count(*) FILTER (best = class AND truth <> class) AS fp, count(*) FILTER (best <> class AND truth = class) AS fn FROM r GROUP BY 1) SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 9) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 9) AS recall, round(avg(auroc), 9) AS auroc, round(avg(aupr), 9) AS aupr, sum(tp)::BIGINT AS correct, round((sum(tp) * sum(tp + fn)::DOUBLE - sum((tp + fp)::DOUBLE * (tp + fn))) / nullif(sqrt((pow(sum(tp + fn), 2) - sum(pow(tp + fp, 2))) * (pow(sum(tp + fn), 2) - sum(pow(tp + fn, 2)))), 0), 9) AS mcc FROM cells JOIN au USING (class)",
    "agg_perf_target": f"WITH {_SOFT}, r AS (SELECT vec_id, label AS truth, CASE WHEN list_max(list_transform(p, lambda x: round(x, 9))) > 0.5 THEN list_position(list_transform(p, lambda x: round(x, 9)), list_max(list_transform(p, lambda x: round(x, 9)))) - 1 END AS best, unnest(range(10)) AS class, unnest(list_transform(p, lambda x: round(x, 9))) AS p FROM soft), ovr AS (SELECT class, p, (truth = class)::INT AS label FROM r WHERE class = 3)"
    + _CURVE.format(by="class", src="ovr")
    + ", cells AS (SELECT class, count(*) FILTER (best = class AND truth = class) AS tp, count(*) FILTER (best = class AND truth <> class) AS fp, count(*) FILTER (best <> class AND truth = class) AS fn, count(*) AS n, count(best) AS called FROM r GROUP BY 1), ev AS (SELECT sum(tp) / max(called) AS acc, (sum(tp) * sum(tp + fn)::DOUBLE - sum((tp + fp)::DOUBLE * (tp + fn))) / nullif(sqrt((pow(sum(tp + fn), 2) - sum(pow(tp + fp, 2))) * (pow(sum(tp + fn), 2) - sum(pow(tp + fn, 2)))), 0) AS mcc, max(called) / max(n) AS prediction_rate FROM cells) SELECT class::INT AS class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(aupr, 9) AS aupr, round(acc, 9) AS acc, round(mcc, 9) AS mcc, round(prediction_rate, 9) AS prediction_rate FROM cells JOIN au USING (class) CROSS JOIN ev WHERE class = 3",
    "agg_gene_share": _W("contigs") + " SELECT genome, round(sum(CASE WHEN len < 2000 THEN len ELSE 0 END) / nullif(sum(len), 0), 9) AS share FROM contigs GROUP BY 1",
    "m_logloss": _W("labelled") + f" SELECT model, genome, round({_LOSS}, 9) AS log_loss FROM labelled WHERE p IS NOT NULL GROUP BY ALL",
    "m_auroc": _curve("model, genome") + " SELECT model, genome, round(auroc, 9) AS auroc FROM au",
    "m_aupr": _curve("model, genome") + " SELECT model, genome, round(aupr, 9) AS aupr FROM au",
    "m_best_thr": _curve("model") + ", v AS (SELECT model, p, unnest(['j', 'f1']) AS criterion, unnest([round(tp / nullif(p_all, 0) - fp / nullif(n_all, 0), 12), round(2 * tp / (tp + fp + p_all), 12)]) AS value FROM cur) SELECT model, p, criterion, value FROM v QUALIFY value = max(value) OVER (PARTITION BY model, criterion)",
    "m_stability": _W("scores") + """, b AS (SELECT a.genome, a.p, b.p AS q FROM scores a JOIN scores b USING (read_id) WHERE a.model = 'gc' AND b.model = 'ag' AND a.p IS NOT NULL AND b.p IS NOT NULL),
        g AS (SELECT genome, round(max(abs(p - q)), 9) AS max_diff, round(avg(abs(p - q)), 9) AS mean_diff, round(quantile_cont(abs(p - q), 0.5), 9) AS median_diff, round(stddev_pop(abs(p - q)), 9) AS std_diff, bool_and(abs(p - q) <= 1e-6 + 1e-5 * abs(q)) AS all_close FROM b GROUP BY 1),
        r AS (SELECT genome, rank() OVER (PARTITION BY genome ORDER BY p) + (count(*) OVER (PARTITION BY genome, p) - 1) / 2 AS ra, rank() OVER (PARTITION BY genome ORDER BY q) + (count(*) OVER (PARTITION BY genome, q) - 1) / 2 AS rb FROM b),
        sp AS (SELECT genome, round(corr(ra, rb), 9) AS spearman FROM r GROUP BY 1),
        u AS (SELECT genome, v, sum(f) AS na, sum(1 - f) AS nb FROM (SELECT genome, p AS v, 1 AS f FROM b UNION ALL SELECT genome, q, 0 FROM b) GROUP BY ALL),
        k AS (SELECT genome, abs(sum(na) OVER w / sum(na) OVER (PARTITION BY genome) - sum(nb) OVER w / sum(nb) OVER (PARTITION BY genome)) AS step FROM u WINDOW w AS (PARTITION BY genome ORDER BY v)),
        ks AS (SELECT genome, round(max(step), 9) AS ks FROM k GROUP BY 1) SELECT * FROM g JOIN sp USING (genome) JOIN ks USING (genome)""",
    "agg_classweight": "SELECT quality * 2 + toxic AS label4, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 9) AS weight FROM labels GROUP BY 1",
    "agg_background": _W("base_counts") + " SELECT genome, round(sum(a) / (count(*) * 250), 9) AS a, round(sum(c) / (count(*) * 250), 9) AS c, round(sum(g) / (count(*) * 250), 9) AS g, round(sum(t) / (count(*) * 250), 9) AS t, count(*) AS reads, round(sum(g + c) / sum(a + c + g + t), 9) AS gc FROM base_counts GROUP BY 1",
    "agg_reads_per": _W("contigs") + " SELECT least(len // 800 + 1, 11)::INT AS bin, count(*) AS n FROM contigs GROUP BY 1",
    "agg_genome_size": _W("contigs") + " SELECT genome, sum(len)::BIGINT AS size, round(log10(sum(len)), 9) AS log_size FROM contigs GROUP BY 1",
    "agg_gene_stats": _W("features") + """, x AS (SELECT *, start - lag("end") OVER (PARTITION BY contig ORDER BY start, "end", type) AS gap FROM features) SELECT contig, count(*) AS genes, round(avg("end" - start), 9) AS mean_len, round(avg(gap), 9) AS mean_gap, string_agg(type, ',' ORDER BY start, "end", type) AS names FROM x GROUP BY 1""",
    "agg_flag_counts": "WITH h AS (SELECT o_orderstatus = 'F' AS conf, o_totalprice > 150000 AS big, o_orderpriority, o_orderdate FROM orders), v AS (SELECT 'new' AS version, * FROM h UNION ALL SELECT 'old', * FROM h WHERE o_orderdate < timestamp '1996-01-01') SELECT version, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in FLAGS.items()) + " FROM v GROUP BY 1",
    "agg_venn": "WITH x AS (SELECT o_custkey, " + ", ".join(f"bool_or({c}) AS {k}" for k, c in _SETS.items()) + " FROM orders GROUP BY 1) SELECT f, o, urgent, big, count(*) AS n FROM x WHERE f OR o OR urgent OR big GROUP BY ALL",
    "agg_runs": _RUNS + f" SELECT model, genome, length::VARCHAR AS length, round(acc, 9) AS acc, round(top, 9) AS top, round(low, 9) AS low FROM runs UNION ALL SELECT model, genome, 'avg', {_MEANS} FROM runs GROUP BY model, genome",
    "agg_pct": _RUNS + " SELECT model, genome, round_even(avg(top) * 100, 3) AS top, round_even(avg(low) * 100, 3) AS low FROM runs GROUP BY ALL",
    "agg_pivot": _RUNS + " SELECT model, genome, " + ", ".join(f'max(round(top, 3)) FILTER (length = {k}) AS "{k}"' for k in (50, 100, 150, 200, 250)) + " FROM runs GROUP BY ALL",
}


def flagship(spark, sf_dir: str):
    """Fragments, scored, classified, pooled by genome and measured against labels."""
    called = X.labelled(spark, sf_dir).where("model = 'gc'")
    pooled = A.pool_genomes(called, T, CONF)
    return pooled.join(M.performance(called, ["genome"], T, CONF), "genome", "left")
