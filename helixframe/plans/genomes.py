"""Queries of joins, genome maps, enrichment and motifs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators import genome as G
from ..operators import joins as J
from ..operators import motif as M
from ..operators.store import stored
from ..sources.files import IUPAC
from . import fixtures as X
from .measures import _round
from .sequences import _gc

_W = X.with_tables
M_LEN = 8
#: The queries' motif bank: match counts above 5 of 8.
MOTIFS = {"f0": "ACGTACGT", "f1": "GATTACAG", "f2": "CCGGTTAA"}
BIAS = 5.0
BG = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}
_RC = {k: v[::-1].translate(str.maketrans("ACGT", "TGCA")) for k, v in MOTIFS.items()}


def _hits(s, d):
    bank = {k: M.one_hot_weights(v) for k, v in MOTIFS.items()}
    return M.motif_scan(X.contigs(s, d), bank, BIAS, ["genome", "contig"])


def _score(motif: str) -> str:
    return " + ".join(f"(substring(k, {i + 1}, 1) = '{b}')::INT" for i, b in enumerate(motif))


_KMERS = "km AS (SELECT genome, contig, pos, substring(seq, pos + 1, 8) AS k FROM (SELECT genome, contig, seq, unnest(range(0, len - 7)) AS pos FROM contigs WHERE len >= 8)), dk AS (SELECT DISTINCT k FROM km)"
_ACT = "act AS (" + " UNION ALL ".join(f"SELECT k, '{f}' AS filter_id, '{st}' AS strand, {_score(m[f])} - {BIAS}::DOUBLE AS activation FROM dk" for f in MOTIFS for st, m in (("+", MOTIFS), ("-", _RC))) + ")"
_HITS = _W("contigs", "features") + f", {_KMERS}, {_ACT}, hits AS (SELECT genome, contig, filter_id, strand, pos, activation, k FROM km JOIN act USING (k) WHERE activation > 0)"


def _placed(s, d):
    return M_PLACED(_hits(s, d).withColumn("read_start", F.lit(0)))


def M_PLACED(hits):
    return G.project_hits(hits, M_LEN)


_PLACED = _HITS + f', placed AS (SELECT genome, contig, filter_id, strand, pos, activation, greatest(pos - {(M_LEN - 1) // 2}, 0) AS start, pos - {(M_LEN - 1) // 2} + {M_LEN} AS "end" FROM hits WHERE pos - {(M_LEN - 1) // 2} + {M_LEN} > 0)'
_OV = 'least(a."end", b."end") - greatest(a.start, b.start)'
_HIT = 'a.start < b."end" AND b.start < a."end"'


def _lengths(s, d):
    """Lengths of contigs, for which texts are read once."""
    return stored(X.contigs(s, d).select("genome", "contig", "len"), "lengths")


def _intervals(s, d, lengths=None):
    return G.genome_map(X.fragment_shares(s, d, "GC"), X.contigs(s, d) if lengths is None else lengths)


#: Scores of bases by byte.
_BASE_SCORES = np.full(256, -0.25)
_BASE_SCORES[[ord(b) for b in "ACN"]] = 1.0, 0.5, 0.0


def _base_scores(seq: pa.Array) -> pa.Array:
    """A score for each base of fragments, which have one byte a base."""
    size = pc.fill_null(pc.binary_length(seq), 0).to_numpy()
    edge = pa.array(np.append(0, np.cumsum(size)), pa.int32())
    letters = np.frombuffer("".join(seq.drop_null().to_pylist()).encode(), np.uint8)
    return pa.ListArray.from_arrays(edge, pa.array(_BASE_SCORES[letters]), mask=seq.is_null())


_MAP = _W("fragments", "features") + """, fr AS (SELECT genome, contig, greatest(start, 0) AS start, least("end", len) AS "end", (length(f.seq) - length(replace(f.seq, 'G', '')) + length(f.seq) - length(replace(f.seq, 'C', ''))) / 250.0::DOUBLE AS p FROM fragments f JOIN (SELECT genome, contig, len FROM contigs) USING (genome, contig) WHERE len > 0),
 pts AS (SELECT genome, contig, unnest([start, "end"]) AS x FROM fr UNION SELECT genome, contig, unnest([0, len]) FROM contigs WHERE len > 0),
 seg AS (SELECT * FROM (SELECT genome, contig, x AS start, lead(x) OVER (PARTITION BY genome, contig ORDER BY x) AS "end" FROM pts) WHERE "end" IS NOT NULL),
 sm AS (SELECT s.genome, s.contig, s.start, s."end", round(avg(p), 12) - 0.5 AS score FROM seg s LEFT JOIN fr b ON s.genome = b.genome AND s.contig = b.contig AND b.start < s."end" AND s.start < b."end" GROUP BY ALL),
 ch AS (SELECT *, CASE WHEN score IS NOT DISTINCT FROM lag(score) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM sm WINDOW w AS (PARTITION BY genome, contig ORDER BY start)),
 rn AS (SELECT *, sum(c) OVER (PARTITION BY genome, contig ORDER BY start) AS run FROM ch),
 imap AS (SELECT genome, contig, min(start) AS start, max("end") AS "end", any_value(score) AS score FROM rn GROUP BY genome, contig, run)"""
_MERGED = """, o AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY genome, contig, {k} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT false THEN 1 ELSE 0 END AS n FROM {src}),
 isl AS (SELECT *, sum(n) OVER (PARTITION BY genome, contig, {k} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o), mg AS (SELECT genome, contig, {k}, min(start) AS start, max("end") AS "end" FROM isl GROUP BY genome, contig, {k}, island)"""
_KEYS = """, fk AS (SELECT DISTINCT genome, CASE type WHEN 'gene' THEN gene WHEN 'CDS' THEN 'CDS' ELSE product END AS key FROM features),
 fm AS (SELECT f.*, key FROM (SELECT *, unnest(list_distinct(CASE type WHEN 'gene' THEN [type, gene, id] ELSE [type, product] END)) AS key FROM features) f SEMI JOIN fk ON f.genome = fk.genome AND f.key = fk.key)"""
_FS = _KEYS + f""", fs AS (SELECT k.genome, k.key, round(sum(score * ov) / sum(ov), 9) AS score, sum(ov)::BIGINT AS bases FROM (SELECT DISTINCT genome, key FROM fm) k LEFT JOIN
 (SELECT a.genome, a.key, score, {_OV} AS ov FROM fm a JOIN imap b ON a.genome = b.genome AND a.contig = b.contig AND {_HIT}) o USING (genome, key) GROUP BY ALL)"""


def _members(s, d, lengths=None):
    f = X.features(s, d, _lengths(s, d) if lengths is None else lengths)
    return G.feature_members(f, G.feature_keys(f))


def _feature_scores(s, d):
    lengths = _lengths(s, d)
    return _round(G.feature_scores(_members(s, d, lengths), _intervals(s, d, lengths)))


def _named_features(s, d):
    """Features of which some lack a gene, and some a name too."""
    return X.features(s, d).withColumns({"gene": F.expr("if(contig % 3 = 0, null, gene)"), "name": F.expr("if(contig % 2 = 0, concat('N', contig % 11), null)")})


def _enriched(s, d):
    lengths = _lengths(s, d)
    return G.enrichment_table(_placed(s, d), _members(s, d, lengths), lengths, M_LEN)


_ENR = _PLACED + _KEYS + _MERGED.format(k="key", src="fm") + f""", pl AS (SELECT key, (2 * (sum("end" - start) + count(*) + {M_LEN} * count(*) - 2 * {M_LEN // 3} * count(*)))::BIGINT AS inside FROM mg GROUP BY 1),
 tot AS (SELECT sum(greatest(2 * (len - {M_LEN} + 1), 0))::BIGINT AS total FROM contigs),
 wi AS (SELECT filter_id, key, count(*) AS a FROM placed a JOIN mg b ON a.genome = b.genome AND a.contig = b.contig AND {_HIT} AND ({_OV}) * 3 >= a."end" - a.start GROUP BY ALL),
 enr AS (SELECT filter_id, key, coalesce(a, 0) AS a, inside - coalesce(a, 0) AS b, h - coalesce(a, 0) AS c, total - inside - h + coalesce(a, 0) AS d FROM (SELECT filter_id, count(*) AS h FROM placed GROUP BY 1) CROSS JOIN pl CROSS JOIN tot LEFT JOIN wi USING (filter_id, key))"""


def _seqs(s, d):
    return M.motif_seqs(_hits(s, d), X.contigs(s, d), M_LEN, ["genome", "contig"])


_SEQS = _HITS + ", seqs AS (SELECT genome, contig, filter_id, strand, pos, activation, CASE strand WHEN '-' THEN translate(reverse(k), 'ACGT', 'TGCA') ELSE k END AS motif FROM hits)"
_MM = _SEQS + ", mm AS (SELECT filter_id, (i - 1)::INT AS pos, substring(motif, i, 1) AS base, count(*)::DOUBLE AS cnt FROM (SELECT filter_id, motif, unnest(range(1, 9)) AS i FROM seqs) GROUP BY ALL)"
_BG = "bg AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base, unnest([0.3, 0.2, 0.2, 0.3])::DOUBLE AS bg)"
_PWM = _MM + f", {_BG}, pw AS (SELECT filter_id, pos, base, coalesce(cnt, 0) AS cnt, bg FROM (SELECT DISTINCT filter_id, pos FROM mm) CROSS JOIN bg LEFT JOIN mm USING (filter_id, pos, base)), pwm AS (SELECT filter_id, pos, base, (cnt + bg) / (sum(cnt) OVER (PARTITION BY filter_id, pos) + 1.0) AS prob, bg FROM pw)"


def _nuc(s, d):
    return _seqs(s, d).select("filter_id", F.posexplode(F.split("motif", "")).alias("pos", "base"), (F.col("activation") / 8).alias("score"))


def _pwm(s, d):
    return M.to_pwm(M.motif_matrix(_seqs(s, d)), BG)


def _weights(s, d):
    rows = [(f, i, b, float(b == x) * (i + 1)) for f, m in MOTIFS.items() for i, x in enumerate(m) for b in "ACGT"]
    return s.createDataFrame(rows, "filter_id string, pos int, base string, w double")


def _line_weights(s, d):
    """Weights from the given tables: filter = supplier, place = line number, base = return flag."""
    return X.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("filter_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("base")).agg(F.avg("l_discount").alias("w"))


def _wide_seqs(s, d):
    """Sub-sequences over all fifteen letters, with weights, from part names."""
    return X.table(s, d, "part").select(F.col("p_size").alias("filter_id"), F.substring(F.translate(F.replace("p_name", F.lit(" ")), _ABC, WIDE), 1, M_LEN).alias("motif"), (F.col("p_retailprice") - 1000).alias("w"))


_ABC = "abcdefghijklmnopqrstuvwxyz"
#: Which of the fifteen letters each small letter stands for.
WIDE = (IUPAC * 2)[:26]
_WIDE = f"sq AS (SELECT p_size AS filter_id, left(translate(replace(p_name, ' ', ''), '{_ABC}', '{WIDE}'), {M_LEN}) AS motif, p_retailprice - 1000 AS w FROM part), mm AS (SELECT filter_id, (i - 1)::INT AS pos, substring(motif, i, 1) AS base, count(*)::DOUBLE AS cnt, sum(abs(w)) AS weighed FROM (SELECT *, unnest(range(1, length(motif) + 1)) AS i FROM sq) GROUP BY ALL)"


def _logodds(s, d):
    return _pwm(s, d).select("filter_id", "pos", "base", F.round("logodds", 9).alias("prob"))


def _contribs(s, d):
    return X.table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("filter_id"), F.col("l_orderkey").alias("read_id")).agg(F.max(F.round(F.col("l_discount") - F.col("l_tax"), 4)).alias("score"))


def _truth(s, d):
    return X.table(s, d, "orders").selectExpr("o_orderkey as read_id", "cast(o_orderstatus = 'F' as int) as label", "cast(o_totalprice > 150000 as int) as called")


def _cells(s, d):
    cell = F.expr("case when label = 1 and called = 1 then 'TP' when label = 1 then 'FN' when called = 1 then 'FP' else 'TN' end")
    return _contribs(s, d).join(_truth(s, d), "read_id").withColumn("cell", cell)


_CON = "WITH con AS (SELECT l_linenumber AS filter_id, l_orderkey AS read_id, max(round(l_discount - l_tax, 4)) AS score FROM lineitem GROUP BY ALL), tru AS (SELECT o_orderkey AS read_id, (o_orderstatus = 'F')::INT AS label, (o_totalprice > 150000)::INT AS called FROM orders), cells AS (SELECT *, CASE WHEN label = 1 AND called = 1 THEN 'TP' WHEN label = 1 THEN 'FN' WHEN called = 1 THEN 'FP' ELSE 'TN' END AS cell FROM con JOIN tru USING (read_id))"

QUERIES = {
    "jn_inner": lambda s, d: J.link_inner(X.table(s, d, "orders").selectExpr("o_custkey as k", "o_orderkey"), X.table(s, d, "customer").selectExpr("c_custkey as k", "c_name"), "k"),
    "jn_left": lambda s, d: J.link_left(X.table(s, d, "customer").selectExpr("c_custkey as k", "c_name as name"), X.table(s, d, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey as k", "o_orderstatus as name", "o_orderkey"), "k"),
    "jn_full": lambda s, d: J.pair_outer(
        X.table(s, d, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderstatus as a"),
        X.table(s, d, "orders").where("o_totalprice > 100000").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderpriority as b"), "k", ["c"]),
    "jn_semi": lambda s, d: J.keep_known(X.table(s, d, "customer").selectExpr("c_custkey as k", "c_name"), X.table(s, d, "orders").selectExpr("o_custkey as k"), "k"),
    "jn_anti": lambda s, d: J.novel_rows(
        X.table(s, d, "orders").where("o_orderdate >= timestamp '1997-01-01'").selectExpr("o_orderkey as k", "concat('c', o_custkey % 5000) as species"),
        X.table(s, d, "orders").where("o_orderdate < timestamp '1994-01-01'").selectExpr("o_orderkey as k", "concat('c', o_custkey % 5000) as species"), "k", "species"),
    "jn_update": lambda s, d: J.update_ids(X.table(s, d, "orders").selectExpr("o_orderkey", "o_custkey as k"), X.table(s, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey as old", "c_custkey + 1000000 as new"), "k"),
    "jn_overlap": lambda s, d: J.overlap(X.features(s, d).selectExpr("genome", "contig", "type", "start", "end"), X.fragments(s, d).selectExpr("genome", "contig", "frag_id", "start", "end"), ["genome", "contig"]),
    "jn_overlap_frac": lambda s, d: J.overlap(X.features(s, d).selectExpr("genome", "contig", "type", "start", "end"), X.fragments(s, d).selectExpr("genome", "contig", "frag_id", "start", "end"), ["genome", "contig"], (1, 3)),
    "jn_contains": lambda s, d: J.name_lookup(
        X.table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("source_name")).union(X.table(s, d, "part").select("p_type")).distinct(),
        X.table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))).groupBy("source_name").agg(F.count("id").alias("n"), F.min("id").alias("first_id")),
    "jn_grid": lambda s, d: J.length_grid(X.table(s, d, "part").selectExpr("p_size as length").distinct()),
    "map_scores": lambda s, d: _round(_intervals(s, d)),
    "map_mean": lambda s, d: _round(G.genome_mean(_intervals(s, d))),
    "map_nt": lambda s, d: G.nt_map(X.fragments(s, d), _base_scores).groupBy("contig").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.sum(F.col("score") * (F.col("pos") % 7)), 6).alias("mixed")),
    "map_merge": lambda s, d: G.merge_intervals(X.features(s, d), ["genome", "contig", "type"]),
    "map_cover": lambda s, d: G.covered_bases(X.features(s, d), ["genome", "contig"], ["genome"]),
    "feat_names": lambda s, d: G.feature_keys(X.features(s, d)),
    "feat_match": lambda s, d: _members(s, d).select("genome", "key", "contig", "type", "start"),
    "feat_score": _feature_scores,
    "rank_genes": lambda s, d: G.rank_features(_feature_scores(s, d)).select("genome", "key", "score", "rank"),
    "rank_genomes": lambda s, d: _round(G.rank_genomes(G.genome_mean(_intervals(s, d)))),
    "hit_project": lambda s, d: _placed(s, d).select("contig", "filter_id", "strand", "start", "end"),
    "hit_dedup": lambda s, d: G.dedup_hits(_placed(s, d)),
    "enr_counts": _enriched,
    "enr_fisher": lambda s, d: G.fisher(_enriched(s, d)).select("filter_id", "key", *(F.expr(f"cast(format_string('%.3e', {c}) as double)").alias(c) for c in ("p", "p_greater", "p_less")), F.round("odds_ratio", 9).alias("odds_ratio")),
    "enr_bh": lambda s, d: G.bh_adjust(X.table(s, d, "lineitem").selectExpr("l_linenumber as filter_id", "l_orderkey", "l_partkey", "round(l_extendedprice / 200000, 6) as p"), ["filter_id"]).groupBy("filter_id").agg(F.count_if(F.col("q") < 0.05).alias("n"), F.round(F.sum("q"), 6).alias("total")),
    "mot_scan": lambda s, d: _hits(s, d),
    "mot_center": lambda s, d: _round(M.center_weights(_line_weights(s, d), _line_weights(s, d).select("filter_id").distinct().withColumn("bias", F.lit(0.5)))[1]),
    "mot_extract": lambda s, d: _seqs(s, d).select("contig", "pos", "filter_id", "strand", "motif"),
    "mot_partial": lambda s, d: M.easy_partials(_seqs(s, d), _weights(s, d)).groupBy("filter_id", "mpos", "base").agg(F.count("*").alias("n"), F.round(F.sum("partial"), 6).alias("total")),
    "mot_counts": lambda s, d: M.motif_matrix(_seqs(s, d)),
    "mot_pwm": lambda s, d: _round(_pwm(s, d).select("filter_id", "pos", "base", "prob", "logodds")),
    "mot_ic": lambda s, d: _round(M.motif_ic(_pwm(s, d))),
    "mot_compare": lambda s, d: _round(M.compare_motifs(_pwm(s, d), _pwm(s, d), 3, 5)),
    "mot_best": lambda s, d: _round(M.best_match(M.correlation_p(M.compare_both_strands(_pwm(s, d), _pwm(s, d), 3, 5))).select("a", "b", "strand", "offset", "cells", "pearson", "p")),
    "mot_best_measures": lambda s, d: _round(M.best_by_measure(M.compare_both_strands(_logodds(s, d), _logodds(s, d), 3, 5))),
    "mot_counts_wide": lambda s, d: _round(M.motif_matrix(_wide_seqs(s, d)).join(M.motif_matrix(_wide_seqs(s, d), "w").withColumnRenamed("cnt", "weighed"), ["filter_id", "pos", "base"]).withColumn("weighed", F.round("weighed", 4))),
    "mot_quartiles": lambda s, d: _round(M.score_quartiles(_cells(s, d))),
    "mot_nt_scaled": lambda s, d: _round(M.nt_logo_table(_nuc(s, d), BG, limits=(0.0, 0.5))),
    "feat_names_ext": lambda s, d: G.feature_keys(_named_features(s, d), True),
    "mot_rank": lambda s, d: _round(M.rank_filters(_contribs(s, d), _truth(s, d))),
    "mot_dist": lambda s, d: M.score_distribution(_cells(s, d).withColumn("score", F.round(F.col("score") * 100)), -10.0, 10.0, 20),
    "mot_nt_mean": lambda s, d: _round(M.nt_logo_table(_seqs(s, d).select("filter_id", F.posexplode(F.split("motif", "")).alias("pos", "base"), (F.col("activation") / 8).alias("score")))),
    "mot_merge": lambda s, d: M.merge_strands(_hits(s, d).groupBy("contig", "filter_id").agg(F.max(F.when(F.col("strand") == "+", F.col("activation"))).alias("f"), F.max(F.when(F.col("strand") == "-", F.col("activation"))).alias("r")), "f", "r", "mean").select("contig", "filter_id", "activation"),
    "top_motif_hit": lambda s, d: M.top_hit(_hits(s, d), ["contig", "filter_id"]).select("contig", "filter_id", "strand", "pos", "activation"),
}
_HC = "log_choose(n, k) AS lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)"

SQL = {
    "jn_inner": "SELECT o_custkey AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "jn_left": "SELECT c_custkey AS k, c_name AS name, o_orderstatus AS name_right, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey",
    "jn_full": "SELECT coalesce(x.k, y.k) AS k, coalesce(x.c, y.c) AS c, a, b FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS a FROM orders WHERE o_orderstatus <> 'P') x FULL JOIN (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS b FROM orders WHERE o_totalprice > 100000) y ON x.k = y.k",
    "jn_semi": "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "jn_anti": "SELECT o_orderkey AS k, 'c' || (o_custkey % 5000) AS species FROM orders WHERE o_orderdate >= timestamp '1997-01-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < timestamp '1994-01-01') AND o_custkey % 5000 NOT IN (SELECT o_custkey % 5000 FROM orders WHERE o_orderdate < timestamp '1994-01-01')",
    "jn_update": "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey + 1000000 ELSE o_custkey END AS k FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey",
    "jn_overlap": _W("features", "fragments") + f' SELECT a.genome, a.contig, a.type, a.start, a."end", b.frag_id, b.start AS b_start, b."end" AS b_end, {_OV} AS ov FROM features a JOIN fragments b ON a.genome = b.genome AND a.contig = b.contig AND {_HIT} AND a.start < a."end"',
    "jn_overlap_frac": _W("features", "fragments") + f' SELECT a.genome, a.contig, a.type, a.start, a."end", b.frag_id, b.start AS b_start, b."end" AS b_end, {_OV} AS ov FROM features a JOIN fragments b ON a.genome = b.genome AND a.contig = b.contig AND {_HIT} AND a.start < a."end" AND ({_OV}) * 3 >= a."end" - a.start',
    "jn_contains": "WITH src AS (SELECT unnest(string_split(p_name, ' ')) AS source_name FROM part UNION SELECT p_type FROM part), nm AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1) SELECT source_name, count(id) AS n, min(id) AS first_id FROM src LEFT JOIN nm ON contains(name, source_name) GROUP BY 1",
    "jn_grid": "WITH l AS (SELECT DISTINCT p_size AS length FROM part) SELECT a.length AS len1, b.length AS len2 FROM l a CROSS JOIN l b",
    "map_scores": _MAP + ' SELECT genome, contig, start, "end", round(score, 9) AS score FROM imap',
    "map_mean": _MAP + ' SELECT genome, round(sum(score * ("end" - start)) / sum("end" - start) + 0.5, 9) AS mean FROM imap WHERE score IS NOT NULL GROUP BY 1',
    "map_nt": _W("fragments") + ", e AS (SELECT contig, start + i AS pos, CASE substring(seq, i + 1, 1) WHEN 'A' THEN 1.0 WHEN 'C' THEN 0.5 WHEN 'N' THEN 0.0 ELSE -0.25 END::DOUBLE AS s FROM (SELECT contig, start, seq, unnest(range(250)) AS i FROM fragments)), m AS (SELECT contig, pos, avg(s) AS score FROM e GROUP BY ALL) SELECT contig, count(*) AS n, round(sum(score), 6) AS total, round(sum(score * (pos % 7)), 6) AS mixed FROM m GROUP BY 1",
    "map_merge": _W("features") + _MERGED.format(k="type", src="features") + " SELECT * FROM mg",
    "map_cover": _W("features") + ", f2 AS (SELECT genome, contig, 1 AS one, start, \"end\" FROM features)" + _MERGED.format(k="one", src="f2") + ' SELECT genome, sum("end" - start)::BIGINT AS bases FROM mg GROUP BY 1',
    "feat_names": _W("features") + _KEYS + " SELECT * FROM fk",
    "feat_match": _W("features") + _KEYS + " SELECT genome, key, contig, type, start FROM fm",
    "feat_score": _MAP + _FS + " SELECT * FROM fs",
    "rank_genes": _MAP + _FS + " SELECT genome, key, score, row_number() OVER (PARTITION BY genome ORDER BY score DESC NULLS LAST, key)::INT AS rank FROM fs",
    "rank_genomes": _MAP + ', g AS (SELECT genome, sum(score * ("end" - start)) / sum("end" - start) + 0.5 AS mean FROM imap WHERE score IS NOT NULL GROUP BY 1) SELECT genome, round(mean, 9) AS mean, row_number() OVER (ORDER BY mean, genome)::INT AS rank FROM g',
    "hit_project": _PLACED + ' SELECT contig, filter_id, strand, start, "end" FROM placed',
    "hit_dedup": _PLACED + ' SELECT filter_id, strand, contig, start, "end", max(activation) AS activation FROM placed GROUP BY ALL',
    "enr_counts": _ENR + " SELECT * FROM enr",
    "enr_bh": "WITH x AS (SELECT l_linenumber AS filter_id, round(l_extendedprice / 200000, 6) AS p FROM lineitem), r AS (SELECT filter_id, p, count(*) OVER (PARTITION BY filter_id) AS n, count(*) OVER (PARTITION BY filter_id ORDER BY p RANGE UNBOUNDED PRECEDING) AS i FROM x), q AS (SELECT filter_id, least(min(p * n / i) OVER (PARTITION BY filter_id ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1.0) AS q FROM r) SELECT filter_id, count(*) FILTER (q < 0.05) AS n, round(sum(q), 6) AS total FROM q GROUP BY 1",
    "mot_scan": _HITS + " SELECT genome, contig, filter_id, strand, pos, activation FROM hits",
    "mot_center": "WITH w AS (SELECT l_suppkey AS filter_id, l_linenumber AS pos, l_returnflag AS base, avg(l_discount) AS w FROM lineitem GROUP BY ALL), m AS (SELECT filter_id, pos, avg(w) AS m FROM w GROUP BY ALL) SELECT filter_id, round(0.5 + sum(m), 9) AS bias FROM m GROUP BY 1",
    "mot_extract": _SEQS + " SELECT contig, pos, filter_id, strand, motif FROM seqs",
    "mot_partial": _SEQS + ", wt(filter_id, motif0) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MOTIFS.items()) + "), e AS (SELECT s.filter_id, contig, pos, strand, activation, (i - 1)::INT AS mpos, substring(motif, i, 1) AS base, CASE WHEN substring(motif, i, 1) = substring(motif0, i, 1) THEN i ELSE 0 END::DOUBLE AS w FROM (SELECT *, unnest(range(1, 9)) AS i FROM seqs) s JOIN wt USING (filter_id)), t AS (SELECT *, w * activation / nullif(sum(w) OVER (PARTITION BY filter_id, contig, pos, strand), 0) AS partial FROM e WHERE base <> 'N') SELECT filter_id, mpos, base, count(*) AS n, round(sum(partial), 6) AS total FROM t GROUP BY ALL",
    "mot_counts": _MM + " SELECT * FROM mm",
    "mot_pwm": _PWM + " SELECT filter_id, pos, base, round(prob, 9) AS prob, round(log2(prob / bg), 9) AS logodds FROM pwm",
    "mot_ic": _PWM + " SELECT filter_id, round(sum(prob * log2(prob / bg)) / count(DISTINCT pos), 9) AS ic FROM pwm GROUP BY 1",
    "mot_compare": _PWM + """, x AS (SELECT p.filter_id AS a, q.filter_id AS b, o AS "offset", p.prob AS pa, q.prob AS pb FROM pwm p CROSS JOIN (SELECT unnest(range(-3, 4))::INT AS o) JOIN pwm q ON q.pos = p.pos + o AND q.base = p.base),
        r AS (SELECT *, rank() OVER (PARTITION BY a, b, "offset" ORDER BY pa) + (count(*) OVER (PARTITION BY a, b, "offset", pa) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b, "offset" ORDER BY pb) + (count(*) OVER (PARTITION BY a, b, "offset", pb) - 1) / 2 AS rb FROM x)
        SELECT a, b, "offset", count(*) AS cells, round(corr(pa, pb), 9) AS pearson, round(corr(ra, rb), 9) AS spearman FROM r GROUP BY ALL HAVING count(*) >= 20""",
    "mot_best": _PWM + """, w AS (SELECT '+' AS strand, filter_id, pos, base, prob FROM pwm UNION ALL SELECT '-', filter_id, max(pos) OVER (PARTITION BY filter_id) - pos, translate(base, 'ACGT', 'TGCA'), prob FROM pwm),
        x AS (SELECT p.filter_id AS a, q.filter_id AS b, strand, o AS "offset", p.prob AS pa, q.prob AS pb FROM w p CROSS JOIN (SELECT unnest(range(-3, 4))::INT AS o) JOIN pwm q ON q.pos = p.pos + o AND q.base = p.base),
        r AS (SELECT a, b, strand, "offset", count(*) AS cells, corr(pa, pb) AS r FROM x GROUP BY ALL HAVING count(*) >= 20),
        t AS (SELECT *, greatest(1 - abs(r) * list_sum(list_transform(range(0, (cells - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1)) / pow(4, k) * pow(greatest(1 - r * r, 0), k))), 0) AS p FROM r)
        SELECT a, b, strand, "offset", cells, round(r, 9) AS pearson, round(p, 9) AS p FROM t QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(p, 9), abs("offset"), "offset", strand) = 1""",
    "mot_best_measures": _PWM + """, lo AS (SELECT filter_id, pos, base, round(log2(prob / bg), 9) AS prob FROM pwm), w AS (SELECT '+' AS strand, * FROM lo UNION ALL SELECT '-', filter_id, max(pos) OVER (PARTITION BY filter_id) - pos, translate(base, 'ACGT', 'TGCA'), prob FROM lo),
        x AS (SELECT p.filter_id AS a, q.filter_id AS b, strand, o AS "offset", p.prob AS pa, q.prob AS pb FROM w p CROSS JOIN (SELECT unnest(range(-3, 4))::INT AS o) JOIN lo q ON q.pos = p.pos + o AND q.base = p.base),
        k AS (SELECT *, rank() OVER (PARTITION BY a, b, strand, "offset" ORDER BY pa) + (count(*) OVER (PARTITION BY a, b, strand, "offset", pa) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b, strand, "offset" ORDER BY pb) + (count(*) OVER (PARTITION BY a, b, strand, "offset", pb) - 1) / 2 AS rb FROM x),
        c AS (SELECT a, b, strand, "offset", count(*) AS cells, corr(pa, pb) AS pearson, corr(ra, rb) AS spearman FROM k GROUP BY ALL HAVING count(*) >= 20),
        r AS (SELECT a, b, strand, "offset", cells, unnest(['pearson', 'spearman']) AS measure, unnest([pearson, spearman]) AS r FROM c),
        t AS (SELECT *, greatest(1 - abs(r) * list_sum(list_transform(range(0, (cells - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1)) / pow(4, k) * pow(greatest(1 - r * r, 0), k))), 0) AS p FROM r)
        SELECT a, b, measure, strand, "offset", cells, round(r, 9) AS r, round(p, 9) AS p FROM t QUALIFY row_number() OVER (PARTITION BY a, b, measure ORDER BY round(p, 9), abs("offset"), "offset", strand) = 1""",
    "mot_counts_wide": f"WITH {_WIDE} SELECT filter_id, pos, base, cnt, round(weighed, 4) AS weighed FROM mm",
    "enr_fisher": _ENR + """, lg AS (SELECT *, a + b AS rw, a + c AS cl, a + b + c + d AS n FROM enr),
        tm AS (SELECT filter_id, key, a AS seen, x, exp(lgamma(rw + 1) - lgamma(x + 1) - lgamma(rw - x + 1) + lgamma(n - rw + 1) - lgamma(cl - x + 1) - lgamma(n - rw - cl + x + 1) - lgamma(n + 1) + lgamma(cl + 1) + lgamma(n - cl + 1)) AS p FROM (SELECT *, unnest(range(greatest(0, rw + cl - n)::BIGINT, least(rw, cl)::BIGINT + 1)) AS x FROM lg)),
        ob AS (SELECT filter_id, key, p AS observed FROM tm WHERE x = seen),
        su AS (SELECT filter_id, key, least(1, sum(p) FILTER (p <= observed * (1 + 1e-7))) AS p, least(1, sum(p) FILTER (x >= seen)) AS p_greater, least(1, sum(p) FILTER (x <= seen)) AS p_less FROM tm JOIN ob USING (filter_id, key) GROUP BY ALL)
        SELECT filter_id, key, printf('%.3e', p)::DOUBLE AS p, printf('%.3e', p_greater)::DOUBLE AS p_greater, printf('%.3e', p_less)::DOUBLE AS p_less, round(a::DOUBLE * d / nullif(b::DOUBLE * c, 0), 9) AS odds_ratio FROM enr JOIN su USING (filter_id, key)""",
    "mot_quartiles": _CON + " SELECT filter_id, cell, " + ", ".join(f"round(quantile_cont(score, {q}), 9) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM cells GROUP BY ALL",
    "mot_nt_scaled": _SEQS + f", {_BG}, e AS (SELECT filter_id, (i - 1)::INT AS pos, substring(motif, i, 1) AS base, activation / 8 AS s FROM (SELECT *, unnest(range(1, 9)) AS i FROM seqs)), m AS (SELECT filter_id, pos, base, sum(s) / (count(*) + any_value(bg)) AS mean FROM e JOIN bg USING (base) GROUP BY ALL) SELECT filter_id, pos, base, round(mean, 9) AS mean, floor(least(greatest(mean / 0.5 * 255, 0), 255))::INT AS level FROM m",
    "feat_names_ext": _W("features") + " SELECT DISTINCT genome, unnest(CASE type WHEN 'gene' THEN [coalesce(CASE WHEN contig % 3 <> 0 THEN gene END, CASE WHEN contig % 2 = 0 THEN 'N' || (contig % 11) END, id)] WHEN 'CDS' THEN ['CDS', product] ELSE [product] END) AS key FROM features",
    "mot_rank": _CON + """, t AS (SELECT count(*) AS reads, count(*) FILTER (label = 1) AS p FROM tru), f AS (SELECT filter_id, count(*) AS nz, sum(score) AS s, min(score) AS lo, max(score) AS hi, count(*) FILTER (score > 0 AND label = 1) AS u1, count(*) FILTER (score > 0 AND label <> 1) AS u0, count(*) FILTER (score < 0 AND label = 1) AS d1, count(*) FILTER (score < 0 AND label <> 1) AS d0 FROM con JOIN tru USING (read_id) WHERE score <> 0 GROUP BY 1),
        v AS (SELECT filter_id, s / nz AS mean_nonzero, s / reads AS mean, CASE WHEN nz < reads THEN least(lo, 0) ELSE lo END AS min, CASE WHEN nz < reads THEN greatest(hi, 0) ELSE hi END AS max, CASE WHEN s >= 0 THEN u1 ELSE d0 END AS tp, CASE WHEN s >= 0 THEN u0 ELSE d1 END AS fp, CASE WHEN s >= 0 THEN p ELSE reads - p END AS tt, CASE WHEN s >= 0 THEN reads - p ELSE p END AS oo, nz / reads AS share FROM f CROSS JOIN t)
        SELECT filter_id, round(mean_nonzero, 9) AS mean_nonzero, round(mean, 9) AS mean, round(min, 9) AS min, round(max, 9) AS max, tp, fp, tt - tp AS fn, oo - fp AS tn, round(share, 9) AS share, round(tp / tt, 9) AS sensitivity, round((oo - fp) / oo, 9) AS specificity, round((tp + oo - fp) / (tt + oo), 9) AS accuracy FROM v""",
    "mot_dist": _CON + " SELECT filter_id, cell, least(floor((round(score * 100) + 10) / 20 * 20), 19)::INT AS bin, count(*) AS n FROM cells GROUP BY ALL",
    "mot_nt_mean": _SEQS + ", e AS (SELECT filter_id, (i - 1)::INT AS pos, substring(motif, i, 1) AS base, activation / 8 AS s FROM (SELECT *, unnest(range(1, 9)) AS i FROM seqs)), m AS (SELECT filter_id, pos, base, sum(s) / (count(*) + 1) AS mean FROM e GROUP BY ALL) SELECT filter_id, pos, base, round(mean, 9) AS mean, floor(least(greatest(mean * 255 + 127.5, 0), 255))::INT AS level FROM m",
    "mot_merge": _HITS + " SELECT contig, filter_id, (coalesce(max(activation) FILTER (strand = '+'), 0) + coalesce(max(activation) FILTER (strand = '-'), 0)) / 2 AS activation FROM hits GROUP BY ALL",
    "top_motif_hit": _HITS + " SELECT contig, filter_id, strand, pos, activation FROM hits QUALIFY row_number() OVER (PARTITION BY contig, filter_id ORDER BY activation DESC, strand, pos) = 1",
}
SQL = {k: v for k, v in SQL.items() if v}
