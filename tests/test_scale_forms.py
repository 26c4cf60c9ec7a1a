"""Forms that spread one group over tasks, against plain versions and with small limits."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import curate, genome, joins, metrics, motif, quantile, sample, score, store, windows
from helixframe.streaming import live


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables too are spread over several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def intervals(rng, n, top, long):
    out = []
    for _ in range(n):
        start = rng.randrange(-50, top)
        out.append((rng.choice("xy"), start, start + rng.choice([0, 1, 7, rng.randrange(1, long)])))
    return out


def test_overlap_of_all_lengths(spark):
    rng = random.Random(4)
    a, b = intervals(rng, 120, 5000, 3000), intervals(rng, 150, 5000, 40)
    want = sorted((c, s, e, s2, e2, min(e, e2) - max(s, s2)) for c, s, e in a for d, s2, e2 in b if c == d and max(s, s2) < min(e, e2))
    ddl = "contig string, start long, end long"
    for base in (0, 2, 10):
        got = joins.overlap(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), ["contig"], base=base)
        assert rows(got.select("contig", "start", "end", "b_start", "b_end", "ov")) == want
    none = spark.createDataFrame([], ddl)
    assert joins.overlap(none, none, ["contig"]).count() == joins.overlap(spark.createDataFrame(a, ddl), none, ["contig"]).count() == 0


def test_bins_grow_with_intervals_not_lengths(spark):
    """A feature of 250 million bases has two rows at its level, as a short one has."""
    df = spark.createDataFrame([(i, i + 250_000_000) for i in range(0, 10**9, 10**7)] + [(i, i + 300) for i in range(0, 10**6, 10**4)], "start long, end long")
    own = df.withColumn("l", joins._level(F.col("end") - F.col("start"), joins.BIN_BITS))
    assert joins.binned(own, F.array("l"), joins.BIN_BITS).count() <= 2 * df.count()


@pytest.mark.parametrize("seed", range(3))
def test_sweep_of_one_contig_over_ranges(spark, seed):
    rng = random.Random(seed)
    data = [(c, s, e) for c, s, e in intervals(rng, 300, 20000, 60) if s < e] + [("x", 5, 4000)]
    covered = {}
    for c, s, e in data:
        covered.setdefault(c, set()).update(range(2 * s, 2 * e + 1))  # touching intervals share an end
    want = []
    for c, places in covered.items():
        for p in sorted(places):
            if p - 1 not in places:
                want.append([c, p // 2, p // 2])
            want[-1][2] = -(-p // 2)
    df = spark.createDataFrame(data, "contig string, start long, end long").repartition(4)
    got = genome.merge_intervals(df, ["contig"])
    assert rows(got.select("contig", "start", "end")) == sorted(map(tuple, want))


def test_one_contig_is_in_many_ranges(spark):
    df = spark.range(0, 40_000, 1, 4).selectExpr("'c' as contig", "id * 10 as start", "id * 10 + 5 as end")
    parted = store.ranged(df, ["contig"], ["start", "end"])
    sizes = [r["count"] for r in parted.groupBy("__range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 30_000
    assert genome.merge_intervals(df, ["contig"]).count() == 40_000


def test_running_and_neighbour_across_ranges(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), i, rng.randrange(-9, 9)) for i in range(500)]
    parted = store.ranged(spark.createDataFrame(data, "g string, t long, v long").repartition(3), ["g"], ["t"])
    got = store.running(parted, ["g"], ["t"], whole=True, s=("sum", F.col("v")), m=("max", F.col("v")))
    got = store.neighbour(got, ["g"], ["t"], "v", "after", True)
    for r in got.collect():
        own = [(t, v) for g, t, v in sorted(data, key=lambda x: x[1]) if g == r.g]
        past = [v for t, v in own if t <= r.t]
        later = [v for t, v in own if t > r.t]
        assert (r.s, r.m, r.s_all, r.m_all) == (sum(past), max(past), sum(v for _, v in own), max(v for _, v in own))
        assert (r.after and r.after.value) == (later[0] if later else None)


def test_exact_quantiles(spark):
    rng = random.Random(6)
    groups = {"flat": [rng.random() for _ in range(700)], "ties": [float(rng.randrange(4)) for _ in range(500)], "one": [2.5], "wide": [rng.choice([1, -1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)], None: [1e308, -1e308, 0.0]}
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("flat", None), ("gone", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    got = {r.g: (r.a, r.b, r.c) for r in quantile.exact_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.9}, parts=8, few=3).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for have, q in zip(got[g], (0.0, 0.25, 0.9), strict=True):
            at = (len(vs) - 1) * q
            lo, hi = sorted(vs)[int(np.floor(at))], sorted(vs)[int(np.ceil(at))]
            assert have == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-12)


def test_no_exact_percentile_in_plans(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2), ("a", 0.4, 0.1)], "g string, p double, q double")
    plan = metrics.compare_scores(df, ["g"], "p", "q")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


@pytest.mark.parametrize("k", [0, 1, 57, 499, 500, 900])
def test_sample_by_hash_digits(spark, k):
    df = spark.range(500).select((F.col("id") % 400).alias("read_id")).repartition(4)
    ordered = df.withColumn("h", sample.hash_order("read_id", 9)).orderBy("h").limit(k)
    for few in (1, 50, 4096):
        got = sample.first_by_hash(df, k, 9, "read_id", few).where("__in")
        assert rows(got.select("read_id")) == rows(ordered.select("read_id"))


def test_sample_stays_spread(spark):
    df = spark.range(0, 20_000, 1, 8).withColumnRenamed("id", "read_id")
    got = sample.sample_k(df, 15_000, 1)
    assert got.count() == 15_000
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_sample_of_null_and_equal_keys(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(7,)] * 60 + [(8,)], "read_id long").repartition(3)
    got = sample.first_by_hash(df, 20, 3, "read_id", few=1)
    assert got.where("__in").count() == 20 and got.count() == 66


def test_shift_parts(spark):
    a, b = spark.range(100).withColumnRenamed("id", "read_id"), spark.range(500, 530).withColumnRenamed("id", "read_id")
    got = {(r.label, r.part): r["count"] for r in sample.shift_dataset(a, b, 40, 1, "read_id").groupBy("label", "part").count().collect()}
    assert got == {(0, "train"): 32, (0, "val"): 8, (1, "train"): 24, (1, "val"): 6}


@pytest.mark.parametrize("letters", [0, 1 << 20])
def test_names_by_automaton_and_by_rarest_gram(spark, letters):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé(") for _ in range(n))
    names = [(word(rng.randrange(0, 30)), i) for i in range(150)] + [(None, 900), ("hot" * 5, 901)]
    sources = sorted({word(rng.randrange(1, 6)) for _ in range(60)} | {"hot", "hotx", "zzz", "abéab"})
    want = sorted([(s, n, i) for s in sources for n, i in names if n and s in n] + [(s, None, None) for s in sources if not any(n and s in n for n, _ in names)], key=str)
    df = spark.createDataFrame([(s,) for s in sources] + [("",), (None,)], "source_name string")
    got = joins.name_lookup(df, spark.createDataFrame(names, "name string, id long"), letters=letters)
    assert sorted((tuple(r) for r in got.where("source_name <> ''").collect()), key=str) == want
    assert got.where("source_name is null or source_name = ''").count() == 2


def test_hot_prefix_waits_at_its_rarest_gram(spark):
    """Sources that share their first letters with every name are joined by other letters of theirs."""
    names = spark.createDataFrame([(f"hot prefix {i:04d}", i) for i in range(500)], "name string, id long")
    words = spark.createDataFrame([(f"hot prefix {i:04d}",) for i in range(0, 500, 50)], "__word string")
    found = joins._by_rarest_gram(words, names, 3)
    assert found.count() == 10


def brute_kmers(seq, k, folded):
    back = str.maketrans("ACGT", "TGCA")
    out = {}
    for i in range(len(seq) - k + 1):
        x = seq[i : i + k]
        if set(x) <= set("ACGT"):
            x = min(x, x[::-1].translate(back)) if folded else x
            out[x] = out.get(x, 0) + 1
    return out


@pytest.mark.parametrize("k", [1, 3, 8, 31])
def test_kmers_in_pieces(spark, k):
    rng = random.Random(8)
    seqs = ["", "A", "ACGTN", None, "".join(rng.choice("ACGTNa") for _ in range(300)), "".join(rng.choice("ACGT") for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(2)
    for folded in (False, True):
        got = score.kmer_codes(df, k, folded, piece=37).select("read_id", score.kmer_text(F.col("code"), k), "n")
        assert rows(got) == sorted((i, x, n) for i, s in enumerate(seqs) if s for x, n in brute_kmers(s, k, folded).items())


def test_kmers_of_a_long_contig(spark):
    """A contig of 100 million letters is counted without its k-mers ever being spelled out."""
    df = spark.range(1).select(F.col("id").alias("read_id"), F.expr("repeat('ACGTTGCANN', 10000000)").alias("seq"))
    got = {r.kmer: r.n for r in score.kmer_features(df, 5).collect()}
    assert got == {x: 10_000_000 for x in ("ACGTT", "CGTTG", "GTTGC", "TTGCA")}


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGTACGTACGT"[::-1].translate(str.maketrans("ACGT", "TGCA"))), (3, "NN")], "read_id long, seq string")
    got = {r.read_id: r.features for r in score.hashed_features(df, 3, 64).collect()}
    assert set(got) == {1, 2} and all(v.size == 64 and abs(v.toArray().sum() - 1) < 1e-12 for v in got.values())
    places = {x: r.p for x, r in ((x, spark.range(1).select(F.pmod(F.xxhash64(F.lit(c).cast("long")), F.lit(64)).alias("p")).first()) for x, c in (("ACG", 6), ("GTA", 44)))}
    assert got[1].toArray()[places["ACG"]] >= 4 / 6


def test_scan_bounds_spare_cells_and_lose_nothing(spark):
    rng = np.random.default_rng(9)
    bank = {f"f{i}": rng.normal(size=(7, 4)) for i in range(3)}
    seqs = [None, "", "ACG", *("".join(rng.choice(list("ACGTN"), 80)) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(seqs)), "read long, seq string").repartition(2)
    bias, want = 4.0, []
    for i, s in enumerate(seqs):
        for name, w in bank.items():
            for strand, m in (("+", w), ("-", w[::-1, ::-1])):
                for p in range(len(s or "") - 6):
                    value = -bias
                    for j in range(7):
                        value += m[j]["ACGT".index(s[p + j])] if s[p + j] in "ACGT" else 0.0
                    if value > 0:
                        want.append((i, name, strand, p, value))
    skipped = spark.sparkContext.accumulator(0)
    assert rows(motif.motif_scan(df, bank, bias, ["read"], skipped)) == sorted(want) and want
    assert skipped.value > 40 * 74 * 6  # of 7 columns most are spared


@pytest.mark.parametrize("rounds", [1, 40])
def test_pointer_jumping_keeps_a_row_a_node(spark, rounds, monkeypatch):
    sizes, kept = [], curate.stored

    def counting(df, name):
        out = kept(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(curate, "stored", counting)
    n = 500
    nodes = spark.createDataFrame([(i, i // 2 if rounds == 1 else i - 1, "family" if i in (1, 9) else "genus") for i in range(1, n + 1)], "taxid long, parent long, rank string")
    got = {r.taxid: r.at_rank for r in curate.nearest_at(nodes, "family").collect()}
    for i in range(1, n + 1):
        at = i
        while at not in (1, 9):
            at = at // 2 if rounds == 1 else at - 1
        assert got[i] == at
    assert set(sizes) == {n} and len(sizes) < 14


def test_merged_ids_and_parents_that_are_missing(spark):
    nodes = spark.createDataFrame([(1, 1, "family"), (2, 1, "genus"), (3, 77, "genus"), (4, None, "genus")], "taxid long, parent long, rank string")
    ids = spark.createDataFrame([(2,), (50,), (3,), (4,), (60,)], "taxid long")
    merged = spark.createDataFrame([(50, 2)], "old long, new long")
    assert sorted(((r.taxid, r.at_rank) for r in curate.ancestor_at(ids, nodes, "family", merged).collect()), key=str) == sorted([(2, 1), (2, 1), (3, None), (4, None), (60, None)], key=str)
    loop = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (3, 1, "x")], "taxid long, parent long, rank string")
    with pytest.raises(ValueError, match="cycle"):
        curate.nearest_at(loop, "family")


def test_ranks_of_strings_by_ranges(spark):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)] + [None]
    df = spark.createDataFrame([(x,) for x in names], "name string").repartition(4)
    got = {r.name: r.code for r in windows.factor_code(df, "name", True).collect()}
    assert got == {**{x: i + 1 for i, x in enumerate(sorted(n for n in names if n))}, None: 0}


def test_shuffle_orders_a_hot_group(spark):
    df = spark.range(0, 3000, 1, 4).selectExpr("'g' as g", "id")
    got = [r.id for r in sample.shuffle(df, 5, ["g"], "id").orderBy("ordinal").collect()]
    assert got == [r.id for r in df.orderBy(sample.hash_order("id", 5), "id").collect()]


def test_running_means_drop_late_reads_and_let_go_of_quiet_genomes(spark, tmp_path):
    day = 86_400_000
    source, marks, landed = str(tmp_path / "in"), str(tmp_path / "marks"), []
    batches = [[("a", 1, 1.0), ("b", 1, 3.0), ("b", 2, None)], [("a", 5, 2.0)], [("a", 6, 3.0), ("a", 2, 100.0), ("b", 1, 100.0)], [("a", 9, 6.0)]]
    before = spark.conf.get(live.STATE_STORE[0], None)
    for batch in batches:
        df = spark.createDataFrame([(g, d * day, p) for g, d, p in batch], "genome string, ms long, p double").selectExpr("genome", "timestamp_millis(ms) as ts", "p")
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        means = live.running_means(stream, "0 seconds", 2 * day)
        live.start_means(means, lambda x, _: landed.extend(tuple(r) for r in x.collect()), marks).awaitTermination()
    assert spark.conf.get(live.STATE_STORE[0], None) == before
    assert [x for x in landed if x[0] == "a"] == [("a", 1.0, 1, False), ("a", 1.5, 2, False), ("a", 2.0, 3, False), ("a", 3.0, 4, False)]
    assert [x for x in landed if x[0] == "b"] == [("b", 3.0, 1, False), ("b", 3.0, 1, True)]  # the late read is dropped
    assert os.path.isdir(marks)


def test_adjusted_p_over_ranges(spark):
    rng = random.Random(10)
    data = [(g, round(rng.random(), 2)) for g in "ab" for _ in range(200)] + [("a", None), (None, 0.5)]
    got = genome.bh_adjust(spark.createDataFrame(data, "g string, p double").repartition(3), ["g"]).collect()
    assert len(got) == len(data)
    for r in got:
        own = sorted(p for g, p in data if g == r.g and p is not None)
        want = None if r.p is None else min(1.0, min(p * len(own) / sum(x <= p for x in own) for p in own if p >= r.p))
        assert r.q == want or r.q == pytest.approx(want)


def test_maps_of_deep_cover_are_exact_sweeps(spark):
    """Many fragments over few places, null and non-finite scores among them, over many ranges of one contig."""
    rng = np.random.default_rng(3)
    size, n = 400, 3000
    first = rng.integers(-20, size, n)
    frags = [("g", "c", int(a), int(a + rng.integers(1, 60)), float(p)) for a, p in zip(first, rng.random(n), strict=True)]
    frags += [("g", "c", 5, 30, None), ("g", "c", 7, 40, float("nan")), ("g", "c", 9, 50, float("inf"))] + [frags[0]] * 50
    df = spark.createDataFrame(frags, "genome string, contig string, start long, end long, p double").repartition(5)
    contigs = spark.createDataFrame([("g", "c", size), ("g", "bare", 9), ("g", "none", 0), ("h", "c", 3)], "genome string, contig string, len long")
    got = genome.genome_map(df, contigs)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    by_contig = {}
    for r in got.collect():
        by_contig.setdefault((r.genome, r.contig), []).append((r.start, r.end, r.score))
    assert by_contig[("g", "bare")] == [(0, 9, None)] and by_contig[("h", "c")] == [(0, 3, None)] and ("g", "none") not in by_contig
    found = [None] * size
    for a, b, score in by_contig[("g", "c")]:
        found[a:b] = [score] * (b - a)
    for x in range(size):
        own = [p for _, _, a, b, p in frags if a <= x < b and p is not None and np.isfinite(p)]
        assert found[x] == pytest.approx(sum(own) / len(own) - 0.5, abs=2e-12) if own else found[x] is None


def test_map_runs_join_equal_neighbours(spark):
    frags = spark.createDataFrame([("g", "c", a, a + 20, 0.75) for a in range(0, 100, 10)], "genome string, contig string, start long, end long, p double")
    contigs = spark.createDataFrame([("g", "c", 200)], "genome string, contig string, len long")
    assert sorted((r.start, r.end, r.score) for r in genome.genome_map(frags, contigs).collect()) == [(0, 110, 0.25), (110, 200, None)]
