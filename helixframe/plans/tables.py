"""Queries of windows, set operations, sampling and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as A
from ..operators import curate as C
from ..operators import sample as S
from ..operators import windows as W
from . import fixtures as X
from .measures import _RUNS, _round, _runs

_T = X.table
_W = X.with_tables
#: Customers that are test ones by hand.
PINNED = [3, 17, 40]
LEVELS = ["5-LOW", "4-NOT SPECIFIED", "1-URGENT"]
RULES = [("NPs", "o_orderstatus = 'F'", True), ("H1", "o_orderpriority = '5-LOW'", False), ("Ps1", "o_totalprice > 250000", True), ("H2", "o_orderstatus = 'P'", False)]
HOSTS = [("human", "o_orderpriority = '1-URGENT'"), ("chordata", "o_orderstatus = 'P'"), ("metazoa", "o_totalprice > 250000")]


def _species(s, d):
    x = X.labelled(s, d).where("model = 'gc'")
    return x.groupBy("label", F.col("genome").alias("species")).agg(F.count("*").alias("n_reads")).withColumn("seq", F.col("species"))


_SPECIES = _W("labelled") + ", sp AS (SELECT label, genome AS species, count(*) AS n_reads FROM labelled WHERE model = 'gc' GROUP BY ALL)"


def _genomes(s, d):
    return X.contigs(s, d).groupBy("genome").agg(F.sum("len").alias("size")).withColumn("class", F.expr("cast(substring(genome, 4) as int) % 2"))


_GENOMES = _W("contigs") + ", ge AS (SELECT genome, sum(len)::BIGINT AS size, substring(genome, 4)::INT % 2 AS class FROM contigs GROUP BY 1)"


def _cust(s, d):
    return _T(s, d, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


def _nodes(s, d):
    return _T(s, d, "part").selectExpr("p_partkey as taxid", "p_partkey div 2 as parent", "case when p_size < 10 then 'species' when p_size < 25 then 'genus' else 'family' end as rank")


_NODES = "nodes AS (SELECT p_partkey AS taxid, p_partkey // 2 AS parent, CASE WHEN p_size < 10 THEN 'species' WHEN p_size < 25 THEN 'genus' ELSE 'family' END AS rank FROM part)"


def _cands(s, d):
    return _T(s, d, "part").selectExpr("p_brand as name", "p_partkey as taxid", "if(p_size % 3 = 0, p_brand, p_type) as species", "if(p_size % 5 = 0, p_brand, p_name) as synonym")


def _asm(s, d):
    """Assemblies with names of both archives, from parts."""
    return _T(s, d, "part").selectExpr(
        "p_partkey", "p_brand", "p_retailprice", "element_at(split(p_name, ' '), -1) as species", "concat(p_name, ' ', p_size) as genome", "if(p_size % 4 = 0, '', concat(p_type, '-', p_size)) as strain",
        "concat(upper(p_name), ' ', lower(p_type), if(p_size % 5 = 0, '', cast(p_size as string))) as organism",
        "case when p_size % 3 = 0 then '' when p_size % 7 = 0 then concat('strain=substr. ', p_size) else concat('strain=', p_size, '-') end as infraspecific",
    )


_ASM = """asm AS (SELECT p_partkey, p_brand, p_retailprice, string_split(p_name, ' ')[-1] AS species, p_name || ' ' || p_size AS genome, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || '-' || p_size END AS strain,
 upper(p_name) || ' ' || lower(p_type) || CASE WHEN p_size % 5 = 0 THEN '' ELSE p_size::VARCHAR END AS organism, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 7 = 0 THEN 'strain=substr. ' || p_size ELSE 'strain=' || p_size || '-' END AS infra FROM part),
 pl AS (SELECT *, lower(replace(genome, '-', '')) AS g, lower(replace(strain, '-', '')) AS s, lower(replace(organism, '-', '')) AS o, trim(lower(replace(replace(infra, 'strain=', ''), '-', ''))) AS i FROM asm),
 ok AS (SELECT *, contains(lower(organism), lower(species)) AND ((i <> '' AND (contains(g, i) OR contains(g, o))) OR (s <> '' AND (contains(i, s) OR contains(o, s)))) AS ok FROM pl)"""


def _selected(s, d):
    """Links of every third part, whose strain may name other parts' organism."""
    return _T(s, d, "part").where("p_partkey % 3 = 0").selectExpr(
        "p_partkey as link", "p_partkey % 11 as project", "p_brand as species", "if(p_size % 4 = 0, '', cast(p_size % 9 as string)) as strain",
        "concat(p_brand, ' ', p_size % 5) as organism", "concat('strain=', p_partkey % 10, ' ', p_size % 4, '-A') as infraspecific",
    )


def _candidates(s, d):
    return _T(s, d, "part").selectExpr(
        "p_partkey as assembly", "p_partkey % 7 as project", "concat(p_brand, ' ', p_size % 13) as organism",
        "case when p_partkey % 6 = 0 then '' when p_partkey % 5 = 0 then 'strain=substr. 1' else concat('strain=', p_size % 4, 'a') end as infraspecific",
    )


_LINKS = """sel AS (SELECT p_partkey AS link, p_partkey % 11 AS project, p_brand AS species, CASE WHEN p_size % 4 = 0 THEN '' ELSE (p_size % 9)::VARCHAR END AS strain, p_brand || ' ' || (p_size % 5) AS organism, 'strain=' || (p_partkey % 10) || ' ' || (p_size % 4) || '-A' AS infra FROM part WHERE p_partkey % 3 = 0),
 cand AS (SELECT p_partkey AS assembly, p_partkey % 7 AS project, p_brand || ' ' || (p_size % 13) AS organism, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'strain=substr. 1' ELSE 'strain=' || (p_size % 4) || 'a' END AS infra FROM part),
 bo AS (SELECT link, assembly, s.project = c.project AS same FROM sel s JOIN cand c ON s.organism = c.organism), bs AS (SELECT link, assembly, s.infra AS ours, c.infra AS theirs FROM sel s JOIN cand c ON s.strain <> '' AND trim(s.species || ' ' || s.strain) = c.organism)"""
_PLAIN = r"lower(regexp_replace({c}, 'strain=|-|\s+', '', 'g'))"


def _cells(s, d):
    return _round(_runs(s, d)).groupBy("genome", "model", "length").agg(F.max("acc").alias("v"))


def _events(s, d):
    return _T(s, d, "orders").selectExpr("o_orderkey as acc", "o_custkey as species", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")


def _evidence(s, d):
    return _T(s, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("species"), F.lower("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("source")).agg(F.min("o_orderkey").alias("seq_no"))


_EVID = "ev AS (SELECT o_custkey AS species, lower(o_orderstatus) AS label, o_orderpriority AS source, min(o_orderkey) AS seq_no FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)"
_MD5 = "md5({k}::VARCHAR || '|{s}')"

QUERIES = {
    "win_offsets": lambda s, d: W.block_offsets(_species(s, d)).select("label", "species", "n_reads", "start", "end"),
    "win_latest": lambda s, d: W.keep_latest(_events(s, d), "species", "o_orderdate", "acc").select("species", "acc"),
    "win_best": lambda s, d: W.best_row(_events(s, d).withColumn("paired", F.expr("o_orderstatus = 'F'")), "species", "paired", "o_orderpriority", LEVELS, "o_orderdate", "acc").select("species", "acc"),
    "win_best_sample": lambda s, d: W.best_sample(_events(s, d), "species", F.col("o_orderstatus"), "acc", "7").select("species", "acc"),
    "win_firstdup": lambda s, d: W.first_row(_events(s, d), ["species", "o_orderstatus"], ["acc"]).select("species", "o_orderstatus", "acc"),
    "win_denserank": lambda s, d: W.factor_code(_T(s, d, "part").selectExpr("p_partkey", "if(p_size % 4 = 0, null, p_brand) as name"), "name", True).select("p_partkey", "name", F.col("code").cast("int").alias("code")),
    "win_lag_cross": lambda s, d: W.threshold_cross(_round(_runs(s, d)).groupBy("genome", "model", "length").agg(F.max("acc").alias("v")), ["genome"], "model", "length", "v", F.lit(0.5)),
    "win_diff": lambda s, d: _round(W.paired_gain(_runs(s, d), ["genome", "length"], "model", "gc", "ac", "acc")),
    "win_envelope": lambda s, d: W.envelope(_runs(s, d).select("model", "genome", "length", "top"), ["model", "length"], "top"),
    "win_cycle": lambda s, d: W.seq_cycles(_T(s, d, "orders").selectExpr("o_orderkey", "o_custkey", "cast(o_orderkey % 250 as int) as len1", "cast(o_custkey % 250 as int) as len2"), ["o_custkey"], "len1", "len2", F.when(F.col("o_custkey") % 3 == 0, 9).otherwise(8), 10),
    "set_label_union": lambda s, d: A.assemble([X.reads(s, d).where(f"contig % 3 = {i}").select("read_id", "seq") for i in range(3)], True, 250).groupBy("label", "rc").agg(F.count("*").alias("n"), F.max("seq").alias("last")),
    "set_offset_union": lambda s, d: A.merge_labelled([X.labels(s, d).select("contig", "label"), X.labels(s, d).select("contig", F.col("label4").alias("label"))]),
    "set_fill_union": lambda s, d: A.union_fill(_T(s, d, "nation").select("n_name", "n_regionkey"), _T(s, d, "supplier").selectExpr("s_name as n_name", "s_acctbal")),
    "set_multi_union": lambda s, d: A.stack_sources([(_T(s, d, "nation"), "n_name"), (_T(s, d, "region"), "r_name"), (_T(s, d, "supplier"), "s_name"), (_T(s, d, "part"), "p_name")]),
    "set_ops": lambda s, d: A.species_sets(_events(s, d).where("o_orderstatus = 'F'"), _events(s, d).where("o_orderstatus = 'P'"), "species"),
    "set_nested": lambda s, d: A.host_partition(_T(s, d, "orders"), "o_custkey", HOSTS),
    "set_expand": lambda s, d: A.expand_labels(_species(s, d)),
    "set_melt": lambda s, d: A.normalise_runs(_T(s, d, "part").selectExpr("p_partkey", "concat(if(p_size % 2 = 0, 'img', 'vhdb'), '_', p_size, '-', p_partkey, 'bp_', element_at(array('cnn', 'lstm', 'res18', 'x'), cast(p_size % 4 + 1 as int)), '_', p_size, 'bp') as file")),
    "smp_split": lambda s, d: S.species_folds(_cust(s, d), 9, 0.1, 5, "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "fold"),
    "smp_split_folds": lambda s, d: S.fold_columns(S.species_folds(_cust(s, d), 3, 0.1, 5, "c_mktsegment", "c_custkey", PINNED), 3).select("c_custkey", "c_mktsegment", "fold1", "fold2", "fold3"),
    "quota_balanced": lambda s, d: S.balanced_quota(_genomes(s, d), 1_000_000, "size", "class", paired=True).withColumn("mode", F.lit("size")).unionByName(S.balanced_quota(_genomes(s, d), 1_000_000, "equal", "class").withColumn("mode", F.lit("equal"))).unionByName(S.read_quota(_genomes(s, d), 250, "coverage", ["class"]).withColumn("mode", F.lit("coverage"))),
    "smp_strain": lambda s, d: S.sample_one(_events(s, d), ["species", "o_orderstatus"], "acc", 3).select("species", "o_orderstatus", "acc"),
    "smp_inherit": lambda s, d: S.inherit_folds([_events(s, d).where(f"o_orderstatus = '{k}'").groupBy("species").agg(F.min(F.expr("cast(acc % 10 as int)")).alias("fold")) for k in "PFO"]),
    "smp_reservoir": lambda s, d: S.sample_k(X.reads(s, d).select("read_id"), 1000, 100),
    "smp_shuffle": lambda s, d: S.shuffle(_events(s, d).select("species", "acc"), 11, ["species"], "acc").withColumn("ordinal", F.col("ordinal").cast("int")),
    "smp_shift": lambda s, d: S.shift_dataset(X.reads(s, d).where("contig % 2 = 0").select("read_id"), X.reads(s, d).where("contig % 2 = 1").select("read_id"), 500, 1, "read_id"),
    "quota_reads": lambda s, d: S.read_quota(_genomes(s, d), 1_000_000, "size", ["class"], True),
    "quota_fragsize": lambda s, d: S.fragment_params(X.contigs(s, d).select("contig", F.col("len").alias("size"))),
    "contig_clean": lambda s, d: S.clean_contigs(X.contigs(s, d).select("genome", "contig", "len"), 9000),
    "cur_filter": lambda s, d: C.filter_genomes(_T(s, d, "part").select("p_partkey", "p_name", "p_type"), {"p_type": "^(standard|small|medium)", "p_name": "e"}, ["p_name"]),
    "cur_rules": lambda s, d: C.apply_rules(_T(s, d, "orders"), RULES).select("o_orderkey", "label", "conflict", "rules"),
    "cur_conflict": lambda s, d: C.resolve_conflicts(_events(s, d).withColumn("label", F.expr("case o_orderstatus when 'F' then true when 'O' then false end")), "species", "label").select("acc", "label", "mixed"),
    "cur_match": lambda s, d: C.resolve_candidates(_events(s, d), "species", F.expr("o_orderstatus = 'F'"), [F.desc("o_orderdate"), "acc"]).select("species", "acc"),
    "cur_extend": lambda s, d: C.extend_links(
        _events(s, d).selectExpr("acc", "species", "acc as assembly"), _events(s, d).where("o_orderstatus = 'P'").selectExpr("species", "acc as assembly", "o_totalprice"), "acc", "species", [F.desc("o_totalprice"), "assembly"]).select("acc", "species", "assembly", "extended"),
    "cur_extend_strain": lambda s, d: C.extend_by_names(_selected(s, d), _candidates(s, d)),
    "win_lag_own": lambda s, d: W.threshold_lines(_cells(s, d), ["genome"], "model", "length", "v", F.expr("model = 'gc' and length = 250")),
    "cur_match_names": lambda s, d: C.resolve_candidates(_asm(s, d), "p_brand", C.species_agrees(F.col("species"), F.col("organism")) & C.strains_agree(*map(F.col, ("genome", "strain", "organism", "infraspecific"))), [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey"),
    "cur_duplicates": lambda s, d: C.resolve_duplicates(_asm(s, d), [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey"),
    "tax_ancestor": lambda s, d: C.ancestor_at(_nodes(s, d).select("taxid"), _nodes(s, d), "family"),
    "tax_merged": lambda s, d: C.ancestor_at(
        _T(s, d, "part").selectExpr("explode(array(p_partkey, p_partkey + 1000000000)) as taxid"), _nodes(s, d), "family",
        _T(s, d, "part").where("p_size % 2 = 1").selectExpr("p_partkey + 1000000000 as old", "p_partkey div 3 as new")),
    "tax_resolve": lambda s, d: C.resolve_names(_T(s, d, "part").selectExpr("p_brand as name").distinct(), _cands(s, d)).select("name", "taxid", "tier"),
    "lab_merge": lambda s, d: C.merge_evidence(_evidence(s, d), ["f", "o"]),
    "lab_tiers": lambda s, d: C.label_tiers(_T(s, d, "orders"), [("confirmed", "o_orderstatus = 'F' and o_totalprice > 200000"), ("plant", "o_orderpriority = '5-LOW'"), ("suspected", "o_orderstatus = 'P'")]).select("o_orderkey", "tier"),
    "lab_temporal": lambda s, d: C.temporal_update(*(_events(s, d).where(f"o_orderdate {op} timestamp '1996-01-01'").groupBy("species").agg(F.max("o_orderstatus").alias("label")) for op in ("<", ">=")), "species", "label"),
    "lab_temporal_test": lambda s, d: C.temporal_test(*(_events(s, d).where(f"o_orderdate {op} timestamp '1993-01-01'").groupBy("species").agg(F.max("o_orderstatus").alias("label")) for op in ("<", ">=")), "species", "label", "1993-01-01"),
    "lab_blast": lambda s, d: C.label_hits(_T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), [("a", _T(s, d, "part").where("p_size < 10").selectExpr("p_partkey as l_partkey")), ("b", _T(s, d, "part").where("p_size < 30").selectExpr("p_partkey as l_partkey"))], "l_partkey").groupBy("target").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("ids")),
}

_E = "e AS (SELECT o_orderkey AS acc, o_custkey AS species, * FROM orders)"
_READS = _W("reads")
SQL = {
    "win_offsets": _SPECIES + ' SELECT label, species, n_reads, (sum(n_reads) OVER w - n_reads)::BIGINT AS start, (sum(n_reads) OVER w)::BIGINT AS "end" FROM sp WINDOW w AS (ORDER BY label, species ROWS UNBOUNDED PRECEDING)',
    "win_latest": f"WITH {_E} SELECT species, acc FROM e QUALIFY row_number() OVER (PARTITION BY species ORDER BY o_orderdate DESC NULLS LAST, acc DESC) = 1",
    "win_best": f"WITH {_E} SELECT species, acc FROM e QUALIFY row_number() OVER (PARTITION BY species ORDER BY (o_orderstatus = 'F') DESC, coalesce(nullif(list_position({LEVELS}, o_orderpriority), 0), {len(LEVELS) + 1}), o_orderdate, acc) = 1",
    "win_best_sample": f"WITH {_E} SELECT species, acc FROM e QUALIFY row_number() OVER (PARTITION BY species ORDER BY o_orderstatus, {_MD5.format(k='acc', s=7)}, acc) = 1",
    "win_firstdup": f"WITH {_E} SELECT species, o_orderstatus, min(acc) AS acc FROM e GROUP BY ALL",
    "win_denserank": "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS name FROM part), c AS (SELECT name, dense_rank() OVER (ORDER BY name) AS code FROM (SELECT DISTINCT name FROM p WHERE name IS NOT NULL)) SELECT p_partkey, p.name, coalesce(code, 0)::INT AS code FROM p LEFT JOIN c ON p.name = c.name",
    "win_lag_cross": _RUNS + ", c AS (SELECT genome, model, length, max(round(acc, 9)) AS v FROM runs GROUP BY ALL) SELECT *, v >= 0.5 AND NOT coalesce(lag(coalesce(v >= 0.5, false)) OVER (PARTITION BY genome, length ORDER BY model), false) AS cross_x, v >= 0.5 AND NOT coalesce(lag(coalesce(v >= 0.5, false)) OVER (PARTITION BY genome, model ORDER BY length), false) AS cross_y FROM c",
    "win_diff": _RUNS + " SELECT genome, length, round(max(acc) FILTER (model = 'gc') - max(acc) FILTER (model = 'ac'), 9) AS gain FROM runs GROUP BY ALL",
    "win_envelope": _RUNS + " SELECT model, genome, length, top FROM runs QUALIFY top = max(top) OVER (PARTITION BY model, length)",
    "win_cycle": "SELECT o_orderkey, o_custkey, (o_orderkey % 250)::INT AS len1, (o_custkey % 250)::INT AS len2, (o_orderkey % 250 + o_custkey % 250 + CASE WHEN o_custkey % 3 = 0 THEN 9 ELSE 8 END)::INT AS cycle FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 10",
    "set_label_union": _READS + ", x AS (SELECT (contig % 3)::INT AS label, false AS rc, seq FROM reads UNION ALL SELECT (contig % 3)::INT, true, translate(reverse(seq), 'ACGT', 'TGCA') FROM reads) SELECT label, rc, count(*) AS n, max(seq) AS last FROM x GROUP BY ALL",
    "set_offset_union": "SELECT doc_id AS contig, quality AS label FROM labels UNION ALL SELECT doc_id, quality * 2 + toxic + 2 FROM labels",
    "set_fill_union": "SELECT n_name, n_regionkey, NULL::DOUBLE AS s_acctbal FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier",
    "set_multi_union": "SELECT n_name AS name, 0 AS source FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT s_name, 2 FROM supplier UNION ALL SELECT p_name, 3 FROM part",
    "set_ops": "WITH a AS (SELECT DISTINCT o_custkey AS species FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS species FROM orders WHERE o_orderstatus = 'P') SELECT 'union' AS op, species FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', species FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a_only', species FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_only', species FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "set_nested": "SELECT o_custkey, CASE " + " ".join(f"WHEN bool_or({c}) THEN '{n}'" for n, c in HOSTS) + " ELSE 'other' END AS level FROM orders GROUP BY 1",
    "set_expand": _SPECIES + " SELECT label, species, unnest(range(1, n_reads + 1)) AS i FROM sp",
    "set_melt": r"WITH f AS (SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 'img' ELSE 'vhdb' END) || '_' || p_size || '-' || p_partkey || 'bp_' || ['cnn', 'lstm', 'res18', 'x'][p_size % 4 + 1] || '_' || p_size || 'bp' AS file FROM part) SELECT *, array_to_string(regexp_extract_all(file, '(\d+-*\d*bp)', 1), '_') AS lengths, nullif(regexp_extract(file, '(cnn|lstm|res18)', 1), '') AS network, nullif(regexp_extract(file, '(img|vhdb)', 1), '') AS dataset FROM f",
    "smp_split": f"WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_MD5.format(k='c_custkey', s=5)}) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), t AS (SELECT *, r <= ceil(n * 0.1) AS t FROM r) SELECT c_custkey, c_mktsegment, (CASE WHEN t THEN 0 ELSE ntile(9) OVER (PARTITION BY c_mktsegment, t ORDER BY r) END)::INT AS fold FROM t",
    "smp_split_folds": f"WITH h AS (SELECT c_custkey, c_mktsegment, c_custkey IN ({', '.join(map(str, PINNED))}) AS pin FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY pin DESC, {_MD5.format(k='c_custkey', s=5)}) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM h), t AS (SELECT *, r <= ceil(n * 0.1) OR pin AS t FROM r), f AS (SELECT *, CASE WHEN t THEN 0 ELSE ntile(3) OVER (PARTITION BY c_mktsegment, t ORDER BY r) END AS fold FROM t) SELECT c_custkey, c_mktsegment, "
    + ", ".join(f"CASE fold WHEN 0 THEN 'test' WHEN {i} THEN 'val' ELSE 'train' END AS fold{i}" for i in (1, 2, 3)) + " FROM f",
    "quota_balanced": _GENOMES + " SELECT genome, size, class, greatest(ceil(size / sum(size) OVER (PARTITION BY class) * 500000), 2)::BIGINT AS reads, 'size' AS mode FROM ge UNION ALL SELECT genome, size, class, greatest(round_even(500000 / count(*) OVER (PARTITION BY class), 0), 1)::BIGINT, 'equal' FROM ge UNION ALL SELECT genome, size, class, greatest(ceil(size / 250), 1)::BIGINT, 'coverage' FROM ge",
    "smp_strain": f"WITH {_E} SELECT species, o_orderstatus, acc FROM e QUALIFY row_number() OVER (PARTITION BY species, o_orderstatus ORDER BY {_MD5.format(k='acc', s=3)}, acc) = 1",
    "smp_inherit": f"WITH {_E}, f AS (SELECT species, o_orderstatus, min((acc % 10)::INT) AS fold FROM e GROUP BY ALL) SELECT species, arg_min(fold, list_position(['P', 'F', 'O'], o_orderstatus)) AS fold FROM f GROUP BY 1",
    "smp_reservoir": _READS + f" SELECT read_id FROM reads ORDER BY {_MD5.format(k='read_id', s=100)}, read_id LIMIT 1000",
    "smp_shuffle": f"SELECT o_custkey AS species, o_orderkey AS acc, row_number() OVER (PARTITION BY o_custkey ORDER BY {_MD5.format(k='o_orderkey', s=11)}, o_orderkey)::INT AS ordinal FROM orders",
    "smp_shift": _READS + f", x AS (SELECT read_id, (contig % 2)::INT AS label FROM reads QUALIFY row_number() OVER (PARTITION BY contig % 2 ORDER BY {_MD5.format(k='read_id', s=1)}, read_id) <= 500) SELECT read_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_MD5.format(k='read_id', s=2)}, read_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'val' END AS part FROM x",
    "quota_reads": _GENOMES + " SELECT genome, size, class, greatest(ceil(size / sum(size) OVER (PARTITION BY class) * 1000000), 2)::BIGINT AS reads FROM ge",
    "quota_fragsize": _W("contigs") + " SELECT contig, len AS size, least(600, len) AS frag_mean, CASE WHEN len < 780 THEN 0 ELSE 60 END AS frag_std, least(250, len) AS read_len FROM contigs",
    "contig_clean": _W("contigs") + " SELECT genome, contig, len FROM contigs QUALIFY len > 9000 OR (max(len) OVER (PARTITION BY genome) <= 9000 AND row_number() OVER (PARTITION BY genome ORDER BY len DESC, contig) = 1)",
    "cur_filter": "SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_type, '^(standard|small|medium)', 'i') AND regexp_matches(p_name, 'e', 'i') AND trim(p_name) <> ''",
    "cur_rules": "WITH h AS (SELECT o_orderkey, " + ", ".join(f"({c}) AS r{i}" for i, (_, c, _) in enumerate(RULES)) + " FROM orders) SELECT o_orderkey, CASE WHEN (r0 OR r2) AND (r1 OR r3) THEN NULL WHEN r0 OR r2 THEN true WHEN r1 OR r3 THEN false END AS label, (r0 OR r2) AND (r1 OR r3) AS conflict, concat_ws(',', " + ", ".join(f"CASE WHEN r{i} THEN '{n}' END" for i, (n, _, _) in enumerate(RULES)) + ") AS rules FROM h",
    "cur_conflict": f"WITH {_E}, l AS (SELECT acc, species, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS label FROM e), m AS (SELECT *, coalesce(bool_or(label) OVER (PARTITION BY species) AND bool_or(NOT label) OVER (PARTITION BY species), false) AS mixed FROM l) SELECT acc, label, mixed FROM m WHERE NOT mixed OR coalesce(label, true)",
    "cur_match": f"WITH {_E}, n AS (SELECT *, count(*) OVER (PARTITION BY species) AS n FROM e) SELECT species, acc FROM n WHERE n = 1 OR o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY species ORDER BY o_orderdate DESC, acc) = 1",
    "cur_extend": f"WITH {_E}, b AS (SELECT species, acc AS fresh FROM e WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY species ORDER BY o_totalprice DESC, acc) = 1) SELECT acc, e.species, coalesce(fresh, acc) AS assembly, fresh IS NOT NULL AND fresh <> acc AS extended FROM e LEFT JOIN b ON e.species = b.species",
    "cur_extend_strain": f"WITH {_LINKS} SELECT link, assembly, same OR assembly IN (SELECT assembly FROM bs) AS linked_by_project, true AS linked_by_organism FROM bo UNION ALL SELECT link, assembly, true, false FROM bs WHERE theirs <> '' AND contains({_PLAIN.format(c='ours')}, {_PLAIN.format(c='theirs')}) AND (NOT contains(theirs, 'substr') OR theirs = ours) AND assembly NOT IN (SELECT assembly FROM bo)",
    "win_lag_own": _RUNS + ", c AS (SELECT genome, model, length, max(round(acc, 9)) AS v FROM runs GROUP BY ALL), t AS (SELECT *, max(v) FILTER (model = 'gc' AND length = 250) OVER (PARTITION BY genome) AS threshold FROM c), u AS (SELECT *, v >= threshold AS up FROM t) SELECT genome, model, length, v, threshold, coalesce(up <> lag(up) OVER (PARTITION BY genome, length ORDER BY model), false) AS cross_x, coalesce(up <> lag(up) OVER (PARTITION BY genome, model ORDER BY length), false) AS cross_y FROM u",
    "cur_match_names": f"WITH {_ASM}, n AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM ok) SELECT p_brand, p_partkey FROM n WHERE n = 1 OR ok QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1",
    "cur_duplicates": f"""WITH {_ASM}, a AS (SELECT * FROM ok QUALIFY count(*) OVER (PARTITION BY organism) = 1 OR ok AND row_number() OVER (PARTITION BY organism ORDER BY ok DESC, p_retailprice DESC, p_partkey) = 1),
        b AS (SELECT * FROM a QUALIFY bool_or(contains(infra, 'substr.')) OVER (PARTITION BY genome) OR row_number() OVER (PARTITION BY genome ORDER BY p_retailprice DESC, p_partkey) = 1)
        SELECT p_partkey FROM b QUALIFY strain = '' OR bool_or(contains(infra, 'substr.')) OVER (PARTITION BY species, strain) OR row_number() OVER (PARTITION BY species, strain ORDER BY p_retailprice DESC, p_partkey) = 1""",
    "tax_ancestor": f"WITH RECURSIVE {_NODES}, up(taxid, a, depth) AS (SELECT taxid, taxid, 0 FROM nodes UNION ALL SELECT up.taxid, parent, depth + 1 FROM up JOIN nodes n ON n.taxid = up.a WHERE n.parent <> n.taxid), h AS (SELECT up.taxid, arg_min(a, depth) AS at_rank FROM up JOIN nodes n ON n.taxid = a WHERE rank = 'family' AND a <> 0 GROUP BY 1) SELECT nodes.taxid, at_rank FROM nodes LEFT JOIN h ON nodes.taxid = h.taxid",
    "tax_merged": f"WITH RECURSIVE {_NODES}, up(taxid, a, depth) AS (SELECT taxid, taxid, 0 FROM nodes UNION ALL SELECT up.taxid, parent, depth + 1 FROM up JOIN nodes n ON n.taxid = up.a WHERE n.parent <> n.taxid), h AS (SELECT up.taxid, arg_min(a, depth) AS at_rank FROM up JOIN nodes n ON n.taxid = a WHERE rank = 'family' AND a <> 0 GROUP BY 1), ids AS (SELECT p_partkey AS taxid FROM part UNION ALL SELECT CASE WHEN p_size % 2 = 1 THEN p_partkey // 3 ELSE p_partkey + 1000000000 END FROM part) SELECT ids.taxid, at_rank FROM ids LEFT JOIN h ON ids.taxid = h.taxid",
    "tax_resolve": "WITH c AS (SELECT p_brand AS name, p_partkey AS taxid, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 5 = 0 THEN 2 ELSE 4 END AS tier FROM part) SELECT name, taxid, tier FROM c QUALIFY tier = min(tier) OVER (PARTITION BY name) AND (tier < 4 OR row_number() OVER (PARTITION BY name ORDER BY tier, taxid) = 1)",
    "lab_merge": f"WITH {_EVID} SELECT species, bool_or(label = 'f') AS f, bool_or(label = 'o') AS o, coalesce(string_agg(source, '; ' ORDER BY seq_no, source) FILTER (label = 'f'), '') AS f_source, coalesce(string_agg(source, '; ' ORDER BY seq_no, source) FILTER (label = 'o'), '') AS o_source FROM ev GROUP BY 1",
    "lab_tiers": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'confirmed' WHEN o_orderpriority = '5-LOW' THEN 'plant' WHEN o_orderstatus = 'P' THEN 'suspected' ELSE 'rest' END AS tier FROM orders",
    "lab_temporal": "WITH a AS (SELECT o_custkey AS species, max(o_orderstatus) AS l FROM orders WHERE o_orderdate < timestamp '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS species, max(o_orderstatus) AS l FROM orders WHERE o_orderdate >= timestamp '1996-01-01' GROUP BY 1) SELECT coalesce(a.species, b.species) AS species, coalesce(b.l, a.l) AS label, CASE WHEN a.l IS NULL THEN 'new' WHEN b.l IS NULL THEN 'kept' WHEN a.l = b.l THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.species = b.species",
    "lab_temporal_test": "SELECT o_custkey AS species, max(o_orderstatus) AS label, '1993-01-01' AS snapshot FROM orders WHERE o_orderdate >= timestamp '1993-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < timestamp '1993-01-01') GROUP BY 1",
    "lab_blast": "WITH x AS (SELECT l_partkey, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' END AS target FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) SELECT target, count(*) AS n, sum(l_partkey)::BIGINT AS ids FROM x GROUP BY 1",
}
