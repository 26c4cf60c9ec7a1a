"""Queries of sources, sinks, scoring and streams."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import motif as M
from ..operators import sample as S
from ..operators import score as R
from ..operators.store import scratch, stored
from ..sources import files as I
from ..streaming import live as L
from . import fixtures as X
from .genomes import _MM, _WIDE, _seqs, _wide_seqs
from .measures import _round

_T, _W = X.table, X.with_tables
WEIGHTS = {"A": -2.0, "C": 1.0, "G": 3.0, "T": -1.0}


def _fasta_trip(s, d):
    """Contigs written as scored records and read back."""
    path = scratch(s, "fasta")
    gc = F.expr("(length(seq) - length(replace(seq, 'G', ''))) / 1000.0D")
    I.write_fasta(X.contigs(s, d).where("len > 0"), path, I.score_header(F.concat(F.lit("c"), F.col("contig")), gc))
    title = F.regexp_extract("title", r"^c(\d+) \| pp=\d+\.\d{3}$", 1)
    return I.read_fasta(s, path, "all").select(title.cast("long").alias("contig"), F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


def _taxdump_trip(s, d):
    """Names, nodes and merged ids written in the dump's form and read back."""
    paths = [scratch(s, f"{x}-dmp") for x in ("nodes", "names", "merged")]
    part, sep = _T(s, d, "part"), F.lit("\t|\t")
    spelled = lambda *cs: F.concat(*[x for c in cs for x in (c.cast("string"), sep)][:-1], F.lit("\t|"))
    part.select(spelled(F.col("p_size"), F.expr("p_size div 2"), F.lit("genus"))).distinct().write.text(paths[0])
    kind = F.when(F.col("p_partkey") % 3 == 0, "scientific name").otherwise("synonym")
    part.select(spelled(F.col("p_size"), F.col("p_name"), F.lit(""), kind)).write.text(paths[1])
    part.select(spelled(F.col("p_partkey") + 1_000_000_000, F.col("p_size"))).write.text(paths[2])
    nodes, names, merged = I.read_taxdump(s, *paths)
    old = merged.groupBy(F.col("new").alias("taxid")).agg(F.count("*").alias("n_merged"))
    return names.join(nodes, "taxid").join(old, "taxid").select("taxid", "name", "parent", "n_merged")


def _hits_trip(s, d):
    """Hits written in twelve columns, in order, and read back; the first line of each query."""
    path = scratch(s, "hits")
    spare = [F.lit(0).alias(f"c{i}") for i in range(8)]
    hits = _T(s, d, "lineitem").select("l_orderkey", "l_partkey", *spare, "l_extendedprice", "l_linenumber")
    hits.repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").write.csv(path, sep="\t")
    return I.first_hit(I.read_hits6(s, path)).select(F.col("query").cast("long").alias("query"), F.col("subject").cast("long").alias("subject"), F.col("bitscore").cast("long").alias("line"))


def _slices_trip(s, d):
    path = scratch(s, "slices")
    I.write_slices(X.reads(s, d).select("read_id"), path, 7, "read_id")
    return s.read.parquet(path).select("read_id", F.col("slice").cast("int").alias("slice"))


def _scored_fasta_trip(s, d):
    path = scratch(s, "scored")
    rows = _T(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.bround(x.cast("double"), 2)).alias("p"), F.translate(F.md5(F.col("vec_id").cast("string")), "0123456789abcdef", "ACGT" * 4).alias("seq"))
    I.write_fasta(rows, path, I.score_header_multi(F.col("vec_id").cast("string"), F.col("p"), 2))
    return I.read_fasta(s, path).select("title", "seq")


def _transfac_trip(s, d):
    path = scratch(s, "transfac")
    I.write_transfac(M.motif_matrix(_seqs(s, d)), path)
    return s.read.text(path).withColumnRenamed("value", "line")


def _wide_transfac_trip(s, d):
    path = scratch(s, "transfac")
    I.write_transfac(M.motif_matrix(_wide_seqs(s, d)), path, I.IUPAC)
    return s.read.text(path).withColumnRenamed("value", "line")


def _transfac_sql(letters: str) -> str:
    heads = ", ".join(f"'{b}'" for b in letters)
    cells = ", ".join(f"printf('%.2f', coalesce(max(cnt) FILTER (base = '{b}'), 0)::DOUBLE)" for b in letters)
    return f", f AS (SELECT DISTINCT filter_id AS f FROM mm) SELECT 'AC' || chr(9) || f AS line FROM f UNION ALL SELECT 'ID' || chr(9) || f FROM f UNION ALL SELECT unnest(['XX', 'XX', 'XX', '//', concat_ws(chr(9), 'PO', {heads})]) FROM f UNION ALL SELECT concat_ws(chr(9), printf('%02d', pos + 1), {cells}) FROM mm GROUP BY filter_id, pos"


def _bed_trip(s, d):
    path = scratch(s, "bed")
    I.write_bed(X.features(s, d), path, ["contig", "start", "end", "type"])
    return s.read.schema("contig long, start long, `end` long, type string").csv(path, sep="\t")


def _gff_trip(s, d):
    path = scratch(s, "gff")
    X.features(s, d).select("contig", F.lit("Genbank"), F.when(F.col("type") == "gene", "region").otherwise(F.col("type")), F.col("start") + 1, "end", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "id", F.lit(";gene="), "gene")).write.csv(path, sep="\t")
    return I.read_gff3(s, path)


def _contrib_trip(s, d):
    path = scratch(s, "contribs")
    rows = _T(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.round("l_tax", 2).alias("t")))).alias("x"))
    text = F.concat(F.lit(">"), F.col("l_orderkey"), F.lit("\n"), F.array_join(F.transform("x", lambda v: v["l_linenumber"].cast("string")), ","), F.lit("\n"), F.when(F.col("l_orderkey") % 5 != 0, F.array_join(F.transform("x", lambda v: v["t"].cast("string")), ",")).otherwise(""))
    rows.select(text).write.text(path)
    return I.read_contribs(s, path, "f0").selectExpr("filter_id", "cast(read_id as long) as read_id", "cast(size(hits) as long) as n", "round(aggregate(hits, 0.0D, (a, h) -> a + h.score * h.pos), 6) as total")


def _fastq_trip(s, d):
    path = scratch(s, "fastq")
    X.reads(s, d).select(F.concat(F.lit("@r"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))).write.text(path, compression="gzip")
    return I.read_fastq(s, f"{path}/part-*", 200, 10, 60).select(F.substring("title", 2, 20).cast("long").alias("read_id"), "seq")


def _scored(s, d):
    return X.reads(s, d).select("read_id", "genome", R.linear_score(F.col("seq"), WEIGHTS, -0.2, X.LENGTH).alias("p"))


def _linear_scorer():
    """The linear model of ``_scored`` as a scorer of one-hot batches."""
    weights = np.array([WEIGHTS[b] for b in R.BASES])
    return lambda x: 1 / (1 + np.exp(0.2 - x.sum(1, dtype=np.float64) @ weights / X.LENGTH))


def _count_rows(s, d, of):
    """Base counts of the reads of some contigs, stored: forests read them several times."""
    return stored(X.base_counts(s, d).join(of, "contig"), "base-counts")


def _folds(s, d):
    folds = S.species_folds(X.labels(s, d), 3, 0.1, 1, key="contig").select("contig", "label", "fold")
    return R.forest_by_fold(_count_rows(s, d, folds), ["a", "c", "g", "t"], 3, "read_id", "label")


def _forest(s, d):
    rows = _count_rows(s, d, X.labels(s, d))
    features = ["a", "c", "g", "t"]
    return R.predict_forest(R.train_forest(rows.where("contig % 5 <> 0"), features), rows, "read_id", "label")


def _kmer_rows(s, d, of):
    """Hashed k-mer vectors of the reads of some contigs, stored: forests read them several times."""
    keep = [c for c in of.columns if c != "contig"]
    reads = R.window_shares(X.contigs(s, d, of), 4, 256, X.LENGTH, X.SHIFT, keep)
    return stored(reads.select((F.col("contig") * 100000 + F.col("frag_id")).alias("read_id"), "contig", *keep, "features"), "kmer-vectors")


def _kmer_forest(s, d):
    rows = _kmer_rows(s, d, X.labels(s, d).select("contig", "label"))
    return R.predict_forest(R.train_forest(rows.where("contig % 5 <> 0"), ["features"]), rows, "read_id", "label")


def _kmer_folds(s, d):
    folds = S.species_folds(X.labels(s, d), 3, 0.1, 1, key="contig").select("contig", "label", "fold")
    return R.forest_by_fold(_kmer_rows(s, d, folds), ["features"], 3, "read_id", "label")


def _route(s, d):
    path, out = scratch(s, "arriving"), scratch(s, "routed")
    I.write_fasta(X.contigs(s, d).where("len > 0"), path, F.concat(F.lit("c"), F.col("contig")))
    L.stream_route(s, path, out, lambda q: (F.length(q) - F.length(F.replace(q, F.lit("G")))) / F.length(q), 0.2).awaitTermination()
    return s.read.parquet(out).select(F.substring("title", 2, 20).cast("long").alias("contig"), "call")


def _pooled_stream(s, d):
    """The pooled stream over the events table; each batch's changed windows land in a table."""
    path = f"{d}/events.parquet"
    folder, file = os.path.split(path)
    source = s.readStream.schema(s.read.parquet(path).schema).option("pathGlobFilter", file).parquet(folder)
    out, marks = scratch(s, "pooled"), scratch(s, "pooled-marks")
    pooled = L.windowed_pool(source.selectExpr("cast(ts as timestamp) as ts", "event_type as genome", "value as p"), "1 day", "0 seconds")
    land = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)
    pooled.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    last = s.read.parquet(out).groupBy("start", "genome").agg(F.max_by(F.struct("score", "n"), "batch").alias("last"))
    return last.select("start", "genome", "last.score", "last.n")


def _running_stream(s, d):
    """Running means as the events arrive in four parts by time; of the first part some come with the third, too late."""
    events = _T(s, d, "events").selectExpr("cast(ts as timestamp) as ts", "event_type as genome", "value as p", "event_id")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - first) * 4 / (last - first + 1)).cast("int")
    parted = events.withColumn("part", F.when((part == 0) & (F.col("event_id") % 10 == 3), 2).otherwise(part))
    arriving, out, marks = scratch(s, "running-in"), scratch(s, "running"), scratch(s, "running-marks")
    for i in range(4):
        parted.where(F.col("part") == i).drop("part", "event_id").write.mode("append").parquet(arriving)
        source = s.readStream.schema("ts timestamp, genome string, p double").parquet(arriving)
        land = lambda df, batch: df.withColumn("part", F.lit(i)).write.mode("append").parquet(out)  # noqa: B023, E731
        L.start_means(L.running_means(source, "0 seconds", 10**12), land, marks).awaitTermination()
    return s.read.parquet(out).select("part", "genome", "score", "n")


QUERIES = {
    "src_fasta": _fasta_trip,
    "src_fastq": _fastq_trip,
    "src_gff3": lambda s, d: _gff_trip(s, d).selectExpr("cast(seqid as long) as contig", "type", "start0", "end", "attrs['gene'] as gene"),
    "contig_len": lambda s, d: I.contig_lengths(_gff_trip(s, d)).select(F.col("contig").cast("long").alias("contig"), "len"),
    "src_scores": lambda s, d: I.read_scores(s, _write(s, "scores", X.scores(s, d).withColumn("p", F.coalesce("p", F.lit(float("nan")))))).groupBy("model").agg(F.count("*").alias("n"), F.count("p").alias("known"), F.round(F.avg("p"), 9).alias("mean")),
    "src_contribs": _contrib_trip,
    "src_taxdump": _taxdump_trip,
    "src_hits6": _hits_trip,
    "snk_slices": _slices_trip,
    "snk_fasta": _scored_fasta_trip,
    "snk_bed": _bed_trip,
    "snk_transfac": _transfac_trip,
    "snk_transfac_wide": _wide_transfac_trip,
    "score_reads": lambda s, d: _round(_scored(s, d)),
    "score_reads_model": lambda s, d: _round(A.pool_replicates(R.score_reads(X.reads(s, d), _linear_scorer, X.LENGTH, replicates=2))),
    "kmer_labels": lambda s, d: R.label_features(R.kmer_features(X.contigs(s, d).select(F.col("contig").alias("read_id"), "seq"), 3), X.labels(s, d).withColumnRenamed("contig", "read_id"), "read_id"),
    "kmer_folded": lambda s, d: R.kmer_codes(X.contigs(s, d).select(F.col("contig").alias("read_id"), "seq"), 8, folded=True).select("read_id", R.kmer_text(F.col("code"), 8).alias("kmer"), "n"),
    "rf_kmer": _kmer_forest,
    "rf_kmer_folds": _kmer_folds,
    "rf_folds": _folds,
    "kmer_features": lambda s, d: R.kmer_features(X.contigs(s, d).select(F.col("contig").alias("read_id"), "seq"), 3),
    "rf_baseline": _forest,
    "stream_filter": _route,
    "stream_genome": lambda s, d: _round(_pooled_stream(s, d)),
    "stream_running": lambda s, d: _round(_running_stream(s, d)),
}


def _write(s, name, df):
    path = scratch(s, name)
    df.write.parquet(path)
    return path


_G = "(length(seq) - length(replace(seq, 'G', '')))"
SQL = {
    "src_fastq": _W("reads") + " SELECT read_id, substring(seq, 11, 50) AS seq FROM reads",
    "src_gff3": _W("features") + " SELECT contig, CASE type WHEN 'gene' THEN 'region' ELSE type END AS type, start AS start0, \"end\", gene FROM features",
    "contig_len": _W("features") + " SELECT contig, \"end\" AS len FROM features WHERE type = 'gene'",
    "src_scores": _W("scores") + " SELECT model, count(*) AS n, count(p) AS known, round(avg(p), 9) AS mean FROM scores GROUP BY 1",
    "src_contribs": "SELECT 'f0' AS filter_id, l_orderkey AS read_id, count(*) AS n, round(sum(round(l_tax, 2) * l_linenumber), 6) AS total FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY l_orderkey",
    "src_taxdump": "WITH n AS (SELECT p_size AS taxid, p_name AS name, p_size // 2 AS parent, count(*) OVER (PARTITION BY p_size) AS n_merged, row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey % 3 <> 0), p_name) AS r FROM part) SELECT taxid, name, parent, n_merged FROM n WHERE r = 1",
    "src_hits6": "SELECT l_orderkey AS query, l_partkey AS subject, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) = 1",
    "src_fasta": _W("contigs") + " SELECT contig, len, md5(seq) AS digest FROM contigs WHERE len > 0",
    "snk_fasta": "SELECT vec_id || ' | pp=' || array_to_string(list_transform(embedding, lambda x: printf('%.2f', round_even(x::DOUBLE, 2) + 0.0)), '; ') AS title, translate(md5(vec_id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM embeddings",
    "snk_transfac": _MM + ", f AS (SELECT DISTINCT filter_id AS f FROM mm) SELECT 'AC' || chr(9) || f AS line FROM f UNION ALL SELECT 'ID' || chr(9) || f FROM f UNION ALL SELECT unnest(['XX', 'XX', 'XX', '//', concat_ws(chr(9), 'PO', 'A', 'C', 'G', 'T')]) FROM f UNION ALL SELECT concat_ws(chr(9), printf('%02d', pos + 1), " + ", ".join(f"printf('%.2f', coalesce(max(cnt) FILTER (base = '{b}'), 0)::DOUBLE)" for b in "ACGT") + ") FROM mm GROUP BY filter_id, pos",
    "snk_transfac_wide": f"WITH {_WIDE}" + _transfac_sql(I.IUPAC),
    "snk_slices": _W("reads") + " SELECT read_id, (ntile(7) OVER (ORDER BY read_id) - 1)::INT AS slice FROM reads",
    "snk_bed": _W("features") + ' SELECT contig, start, "end", type FROM features',
    "score_reads": _W("base_counts") + " SELECT read_id, genome, round(1 / (1 + exp(-(-0.2 + " + " + ".join(f"{w} * {b.lower()} / 250" for b, w in WEIGHTS.items()) + "))), 9) AS p FROM base_counts",
    "score_reads_model": _W("base_counts") + " SELECT read_id, round(1 / (1 + exp(-(-0.2 + " + " + ".join(f"{w} * {b.lower()} / 250" for b, w in WEIGHTS.items()) + "))), 9) AS p, 0.0::DOUBLE AS p_std, 2 AS replicates FROM base_counts",
    "kmer_labels": _W("contigs") + ", k AS (SELECT contig AS read_id, substring(seq, i, 3) AS kmer FROM (SELECT contig, seq, unnest(range(1, len - 1)) AS i FROM contigs)) SELECT read_id, kmer, count(*) AS n, any_value(quality) AS label FROM k LEFT JOIN labels ON doc_id = read_id WHERE NOT contains(kmer, 'N') GROUP BY read_id, kmer",
    "kmer_folded": _W("contigs") + ", k AS (SELECT contig AS read_id, substring(seq, i, 8) AS f FROM (SELECT contig, seq, unnest(range(1, len - 6)) AS i FROM contigs)) SELECT read_id, least(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer, count(*) AS n FROM k WHERE NOT contains(f, 'N') GROUP BY ALL",
    "kmer_features": _W("contigs") + ", k AS (SELECT contig AS read_id, substring(seq, i, 3) AS kmer FROM (SELECT contig, seq, unnest(range(1, len - 1)) AS i FROM contigs)) SELECT read_id, kmer, count(*) AS n FROM k WHERE NOT contains(kmer, 'N') GROUP BY ALL",
    "stream_filter": _W("contigs") + f" SELECT contig, CASE WHEN {_G} / len > 0.2 THEN 'pos' ELSE 'neg' END AS call FROM contigs WHERE len > 0",
    "stream_running": "WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), e AS (SELECT event_type AS genome, event_id, value, floor((epoch_us(ts) - lo) * 4 / (hi - lo + 1))::INT AS part FROM events CROSS JOIN b), k AS (SELECT * FROM e WHERE NOT (part = 0 AND event_id % 10 = 3)) SELECT p.part, genome, round(avg(value), 9) AS score, count(value) AS n FROM (SELECT unnest(range(4))::INT AS part) p JOIN k ON k.part <= p.part GROUP BY ALL",
    "stream_genome": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS genome, round(avg(value), 9) AS score, count(value) AS n FROM events GROUP BY ALL",
}
