"""Small exact cases of operators that SQL does not state, and properties that always hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import seq as S
from helixframe.operators import assemble, classify, curate, genome, metrics, motif, sample, score
from helixframe.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_hot_flatten(spark):
    df = spark.createDataFrame([("ACGT",), ("aN",)], "seq string")
    got = [r[0] for r in df.select(S.flatten_one_hot(S.one_hot(F.col("seq"), 4))).collect()]
    assert got == [[1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], [1] + [0] * 15]


def test_revcomp_twice(spark):
    df = spark.createDataFrame([("ACGTNNA",), ("",), (None,)], "seq string")
    assert all(r[0] == r[1] for r in df.select("seq", S.revcomp(S.revcomp(F.col("seq")))).collect())


def test_over_long_read_raises(spark):
    df = spark.createDataFrame([("ACGTA",)], "seq string")
    assert S.fit_length(df, 4, trim=True).first()[0] == "ACGT"
    with pytest.raises(Exception, match="longer than 4"):
        S.fit_length(df, 4).collect()


def test_fasta_fastq_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACG\nTAC\n>two\nGG\n\n")
    assert rows(files.read_fasta(spark, str(tmp_path / "a.fasta"), "s").select("set", "title", "seq")) == [("s", "one x", "ACGTAC"), ("s", "two", "GG")]
    (tmp_path / "a.fastq").write_text("@r1\nACGTACGT\n+\n@@@@@@@@\n@r2\nAC\n+\n>>\n")
    assert rows(files.read_fastq(spark, str(tmp_path / "a.fastq"), 4, 2, 6)) == [("r1", "GTAC")]


def test_taxdump(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tBe\t|\t\t|\tsynonym\t|\n2\t|\tCe\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "merged.dmp").write_text("9\t|\t2\t|\n")
    n, m, g = files.read_taxdump(spark, *(str(tmp_path / f"{x}.dmp") for x in ("nodes", "names", "merged")))
    assert (rows(n), rows(m), rows(g)) == ([(2, 1, "genus")], [(2, "Ce")], [(9, 2)])


def test_score_headers(spark):
    df = spark.createDataFrame([("a", 0.12345, 0.004), ("b", 0.5, None)], "t string, p double, sd double")
    got = [r[0] for r in df.select(files.score_header(F.col("t"), F.col("p"), F.col("sd"))).collect()]
    assert got == ["a | pp=0.123 +/- 0.004", "b | pp=0.500"]


def brute_fisher(a, b, c, d):
    def choose(n, k):
        return math.comb(n, k) if 0 <= k <= n else 0

    total = choose(a + b + c + d, a + c)
    p = {x: choose(a + b, x) * choose(c + d, a + c - x) / total for x in range(a + b + 1)}
    two = sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))
    return min(1, two), sum(v for x, v in p.items() if x >= a), sum(v for x, v in p.items() if x <= a)


def test_fisher():
    rng = random.Random(3)
    for _ in range(300):
        cell = [rng.randrange(0, 25) for _ in range(4)]
        if sum(cell):
            assert genome.fisher_p(*cell) == pytest.approx(brute_fisher(*cell), rel=1e-9, abs=1e-12)


def test_correlation_p():
    assert motif.correlation_p_value(0.5, 12) == pytest.approx(0.0979, abs=2e-4)
    assert motif.correlation_p_value(0.0, 10) == pytest.approx(1.0)
    assert motif.correlation_p_value(1.0, 10) == 0.0


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 7), ("c", 9, 12), ("c", 10, 11)], "contig string, start long, end long")
    once = genome.merge_intervals(df, ["contig"])
    assert rows(once) == [("c", 0, 7), ("c", 9, 12)] == rows(genome.merge_intervals(once, ["contig"]))


def test_auroc_of_reversed_scores(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("g", rng.randrange(5) / 4, rng.randrange(2)) for _ in range(200)], "g string, p double, label int")
    a = metrics.auroc(df, ["g"]).first().auroc
    b = metrics.auroc(df.withColumn("p", 1 - F.col("p")), ["g"]).first().auroc
    assert a + b == pytest.approx(1)


def test_calls_cover_all_rows(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.55,), (0.9,), (None,)], "p double")
    got = [r[0] for r in df.select(classify.classify(F.col("p"), 0.5, 0.6)).collect()]
    assert got == ["neg", "undef", "undef", "pos", "undef"]


def test_fold_sets_are_disjoint(spark):
    df = spark.range(103).selectExpr("id as species", "id % 2 as label")
    folds = sample.species_folds(df, 4, 0.1, 1)
    assert folds.count() == 103 == folds.select("species").distinct().count()
    sizes = [r["count"] for r in folds.where("fold > 0").groupBy("label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_slices_differ_by_one(spark):
    got = files.with_slices(spark.range(23).repartition(5), 4, "id")
    assert [r["count"] for r in got.groupBy("slice").count().orderBy("slice").collect()] == [6, 6, 6, 5]


def test_score_reads_and_partitions(spark):
    reads = spark.createDataFrame([(1, "GGGG"), (2, "AAGN"), (3, "")], "read_id long, seq string")
    made = lambda: lambda x: x[:, :, 2].mean(1)
    got = rows(score.score_reads(reads.repartition(3), made, 4, replicates=2))
    assert got == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.25), (2, 1, 0.25), (3, 0, 0.0), (3, 1, 0.0)]


def test_augmented_rows(spark):
    one = spark.createDataFrame([(1, "AC")], "read_id long, seq string")
    assert rows(assemble.assemble([one, one], True).select("seq", "label", "rc")) == [("AC", 0, False), ("AC", 1, False), ("GT", 0, True), ("GT", 1, True)]


def test_one_base_contig_and_gap(spark):
    contigs = spark.createDataFrame([("g", "a", 1), ("g", "b", 10)], "genome string, contig string, len long")
    frags = spark.createDataFrame([("g", "a", -2, 3, 0.75), ("g", "b", 0, 4, 0.75), ("g", "b", 6, 12, 0.75)], "genome string, contig string, start long, end long, p double")
    got = genome.genome_map(frags, contigs).orderBy("contig", "start").collect()
    assert [(r.contig, r.start, r.end, r.score) for r in got] == [("a", 0, 1, 0.25), ("b", 0, 4, 0.25), ("b", 4, 6, None), ("b", 6, 10, 0.25)]


def test_ancestors_climb_deep_trees_to_their_end(spark):
    n = 300
    nodes = spark.createDataFrame([(i, i - 1, "family" if i == 1 else "genus") for i in range(1, n + 1)], "taxid long, parent long, rank string")
    got = rows(curate.ancestor_at(nodes.select("taxid"), nodes, "family"))
    assert got == [(i, 1) for i in range(1, n + 1)]


def test_tax_ancestor_has_no_cap_on_depth(spark, tmp_path):
    from helixframe.plans import tables

    chain = [1 << i for i in range(25)]
    spark.createDataFrame([(k, 50 if k == 1 else 5) for k in chain], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert rows(tables.QUERIES["tax_ancestor"](spark, str(tmp_path)).select("taxid", "at_rank")) == [(k, 1) for k in chain]


def test_cycle_of_parents_raises(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4)], "taxid long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        curate.ancestors(nodes)


def test_strains_agree_without_dashes_and_case(spark):
    cases = [
        ("Be coli K-12", "", "Be coli", "strain=K12", True), ("Be coli", "k-12", "Be coli K12", "", True),
        ("Be coli", "", "Ce coli", "", False), ("Be coli", None, None, None, False), ("Be coli", "x1", "Be coli", "strain=y", True), ("Be", "x1", "Be coli", "strain=y", False),
    ]
    df = spark.createDataFrame(cases, "genome string, strain string, organism string, infra string, want boolean")
    got = df.select(curate.strains_agree(*map(F.col, ("genome", "strain", "organism", "infra"))).alias("got"), "want").collect()
    assert [bool(r.got) for r in got] == [r.want for r in got]


def test_one_of_each_keeps_rows_alone_without_key_and_exempt(spark):
    data = [(1, "a", True, False), (2, "a", True, False), (3, "b", False, False), (4, None, False, False), (5, None, False, False), (6, "c", True, True), (7, "c", False, False), (8, "d", False, False), (9, "d", True, False), (10, "e", False, False), (11, "e", None, False)]
    df = spark.createDataFrame(data, "id long, k string, ok boolean, sub boolean")
    got = curate.one_of_each(df, "k", ["id"], F.col("ok"), F.col("sub"))
    assert [r[0] for r in rows(got)] == [1, 3, 4, 5, 6, 7, 9]


def test_pinned_species_are_tested_beyond_their_share(spark):
    folds = sample.species_folds(spark.range(20).selectExpr("id as species", "0 as label"), 3, 0.1, 1, pinned=[4, 9, 13])
    assert [r[0] for r in rows(folds.where("fold = 0").select("species"))] == [4, 9, 13]
    parts = rows(sample.fold_columns(folds, 3).where("fold = 2").select("fold1", "fold2", "fold3").distinct())
    assert parts == [("train", "val", "train")]
