"""What only larger or odder tables show: titles, forms of results and plans that must not grow beyond their input."""

import glob
import random
import re
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import curate, fragment, genome, motif, score
from helixframe.plans import catalog, fixtures, genomes, sequences

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


@pytest.fixture
def tables(tmp_path):
    """A folder of the small tables in which a test replaces some."""
    shutil.copytree(SF, tmp_path / "sf")
    return tmp_path / "sf"


def replace(spark, folder, name, df):
    (folder / f"{name}.parquet").unlink()
    df.write.parquet(str(folder / f"{name}.parquet"))


def test_fasta_titles_of_long_contigs(spark, tables):
    """A contig of over 10,000 G has a score of two digits before the point."""
    texts = {1: "g" * 12_345 + "a", 2: "acg", 3: ""}
    replace(spark, tables, "documents", spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(tuple(r)[:2] for r in QUERIES["src_fasta"](spark, str(tables)).collect()) == [(1, 12_346), (2, 3)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", (7, 1 << 18))
def test_short_kmers_make_vectors_without_a_shuffle(spark, monkeypatch, piece):
    monkeypatch.setattr(score, "PIECE", piece)
    rng = random.Random(3)
    data = [(i, f"k{i}", "".join(rng.choices("ACGTNacx", [9, 9, 9, 9, 1, 1, 1, 1], k=rng.randrange(0, 90)))) for i in range(60)] + [(60, "k", None), (61, "k", "ACG")]
    df = spark.createDataFrame(data, "read_id long, mark string, seq string")
    got = score.hashed_features(df, 4, 32, keep=("mark",))
    assert "Exchange" not in plan(got)
    monkeypatch.setattr(score, "DENSE", 3)
    want = score.hashed_features(df, 4, 32, keep=("mark",))
    spelled = lambda x: sorted((r.read_id, r.mark, tuple(r.features.toArray())) for r in x.collect())
    assert spelled(got) == spelled(want) and got.count() > 40


@pytest.mark.parametrize("some", (5, 2048))
def test_vectors_of_windows_are_those_of_reads(spark, monkeypatch, some):
    """Of every window of ``fragment``, short pieces and long, odd letters and nulls; windows without a k-mer have none."""
    monkeypatch.setattr(score, "WINDOWS", some)
    monkeypatch.setattr(fragment, "PIECE", 8)
    rng = random.Random(6)
    data = [("g", i, "".join(rng.choices("ACGTNac", [9, 9, 9, 9, 3, 1, 1], k=rng.randrange(0, 400))), i % 3) for i in range(40)] + [("g", 40, None, 1), ("g", 41, "N" * 90, 2), ("g", 42, "ACG", 0)]
    df = spark.createDataFrame(data, "genome string, contig long, seq string, label int").withColumn("len", F.length("seq").cast("long"))
    got = score.window_shares(df, 4, 32, 40, 10, ["label"])
    assert "Exchange" not in plan(got)
    reads = fragment.fragment(df, 40, 10).join(df.select("contig", "label"), "contig")
    want = score.hashed_features(reads.withColumn("read_id", F.col("contig") * 1000 + F.col("frag_id")), 4, 32, keep=("label",))
    spelled = lambda x: sorted((r.read_id, r.label, tuple(r.features.toArray())) for r in x.collect())
    assert spelled(got.withColumn("read_id", F.col("contig") * 1000 + F.col("frag_id"))) == spelled(want) and got.count() > 300
    assert not score.window_shares(df.limit(0), 4, 32, 40, 10).count()


@pytest.mark.parametrize("name", ("rf_kmer", "rf_kmer_folds"))
def test_contigs_meet_labels_before_they_are_spelled(spark, monkeypatch, name):
    """No read is joined or shuffled, nor is any made of a contig without a label."""
    seen = []
    monkeypatch.setattr(score, "window_shares", lambda contigs, *a: seen.append(contigs) or shares(contigs, *a))
    QUERIES[name](spark, SF)
    (contigs,) = seen
    shown = plan(contigs)
    assert shown.index("ArrowEvalPython") < shown.index("Join") and contigs.count() == spark.read.parquet(f"{SF}/labels.parquet").count()


shares = score.window_shares


def test_one_hot_text(spark):
    df = spark.createDataFrame([("ACGTN",), ("acxg",), ("",), ("A" * 9,), ("é\n😀T",), (None,)], "seq string")
    arrays = F.array_join(F.transform(seq.flatten_one_hot(seq.one_hot(F.col("seq"), 6)), lambda x: x.cast("string")), "")
    json = F.to_json(seq.one_hot(F.col("seq"), 6))
    text = F.concat(F.lit("["), F.rtrim(seq.one_hot_text(F.col("seq"), 6, *sequences._JSON), F.lit(",")), F.lit("]"))
    for a, b, c, d in df.select(arrays, seq.one_hot_text(F.col("seq"), 6), json, text).collect():
        assert a == b and c == d
    assert "lambda" not in plan(QUERIES["seq_flatten"](spark, SF)) + plan(QUERIES["seq_encode"](spark, SF))


def test_largest_prefixes_sort_no_reads(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("a", "AT"), ("a", "ATAA"), ("b", "C"), ("b", "")], "genome string, seq string")
    got = {(r.genome, r.k): (r.n, r.seq) for r in seq.subreads(seq.largest_read(df, "genome"), [1, 3]).collect()}
    assert got == {("a", 1): (3, "A"), ("a", 3): (3, "ATA"), ("b", 1): (2, "C"), ("b", 3): (2, "C")}
    shown = plan(QUERIES["seq_subread"](spark, SF))
    assert "SortAggregate" not in shown and "Sort [" not in shown


def folders(spark, name):
    return set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{name}-*"))


def test_fastq_is_written_compressed(spark):
    old = folders(spark, "fastq")
    QUERIES["src_fastq"](spark, SF)
    (new,) = folders(spark, "fastq") - old
    parts = glob.glob(f"{new}/part-*")
    assert parts and all(x.endswith(".gz") for x in parts)


@pytest.mark.parametrize("name", ("rf_baseline", "rf_folds"))
def test_forests_read_stored_counts(spark, name):
    old = folders(spark, "base-counts")
    shown = plan(QUERIES[name](spark, SF))
    assert folders(spark, "base-counts") - old and "documents" not in shown


def test_links_join_only_where_they_come_out(spark):
    """Flags of assemblies come from linear joins; the rows are those of the plain rule."""
    rng = random.Random(8)
    infra = ["", None, "strain=1 a", "1A", "strain=substr. 1", "substr1", "strain=21-a"]
    sel = [(i, rng.choice([1, 2, None]), rng.choice("st"), rng.choice(["", None, "1", "2"]), rng.choice(["s 1", "s 3", "t 4", None]), rng.choice(infra)) for i in range(40)]
    cand = [(rng.randrange(50), rng.choice([1, 2, None]), rng.choice(["s 1", "s 2", "t 1", "t 4", None]), rng.choice(infra)) for _ in range(60)]
    text = "link long, project long, species string, strain string, organism string, infraspecific string"
    got = curate.extend_by_names(spark.createDataFrame(sel, text), spark.createDataFrame(cand, "assembly long, project long, organism string, infraspecific string"))
    plain = lambda x: re.sub(r"strain=|-|\s+", "", x or "").lower()
    by_name = [(s, c) for s in sel for c in cand if s[4] is not None and s[4] == c[2]]
    by_strain = [(s, c) for s in sel for c in cand if s[3] and f"{s[2]} {s[3]}" == c[2]]
    seen, linked = {c[0] for _, c in by_strain}, {c[0] for _, c in by_name}
    want = [(s[0], c[0], (s[1] is not None and s[1] == c[1]) or c[0] in seen, True) for s, c in by_name]
    within = lambda s, c: c[3] and plain(c[3]) in plain(s[5]) and ("substr" not in plain(c[3]) or c[3] == s[5])
    want += [(s[0], c[0], True, False) for s, c in by_strain if within(s, c) and c[0] not in linked]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(not w[3] for w in want)
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("LeftSemi") >= 2


@pytest.mark.parametrize("name", ("jn_zip_check", "src_hits6", "cur_extend_strain"))
def test_keys_that_compress_well_stay_in_many_tasks(spark, name):
    """Adaptive plans must not join the parts whose rows are far larger than their bytes."""
    shown = plan(QUERIES[name](spark, SF))
    assert "REPARTITION_BY_NUM" in shown


@pytest.mark.parametrize("scan", (5, 1 << 17))
def test_motif_scan_by_small_arrow_blocks(spark, monkeypatch, scan):
    monkeypatch.setattr(motif, "SCAN", scan)
    texts = ["ACGTACGT", None, "", "éACG😀TTACGA", "ACG", "GACGTT" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "read long, seq string").coalesce(1)
    got = motif.motif_scan(df, {"f": motif.one_hot_weights("ACG")}, 2.5, ["read"])
    assert "MapInArrow" in plan(got) and "MapInPandas" not in plan(got)
    want = [(i, "f", s, p, 0.5) for i, t in enumerate(texts) for s, m in (("+", "ACG"), ("-", "CGT")) for p in range(len(t or "")) if t[p : p + 3] == m]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_per_base_scores_travel_in_blocks(spark):
    """Bases are summed up where fragments are; no row a base is shuffled, whatever starts, gaps and nulls there are."""
    rng = random.Random(5)
    data = [(c, rng.choice([None, -3, 0, 10, 1020, 2047, 10**12]), [rng.choice([None, 0.5, 1.0, -0.25]) for _ in range(rng.choice([0, 1, 7, 2100]))]) for c in ("a", "b", None) for _ in range(30)]
    df = spark.createDataFrame([*data, ("a", 1, None)], "contig string, start long, score array<double>")
    each = df.select("contig", "start", F.posexplode("score").alias("i", "s"))
    want = each.groupBy("contig", (F.col("start") + F.col("i")).alias("pos")).agg(F.avg("s").alias("score"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = genome.nt_map(df.repartition(3))
        assert "Generate" not in plan(got)
        rows = sorted(map(str, map(tuple, got.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == sorted(map(str, map(tuple, want.collect()))) and len(rows) > 6000


def test_maps_sort_bounds_once_and_join_runs_over_blocks(spark):
    """Blocks of 16 places give the runs of whole contigs; short contigs' bounds are shuffled once, with no join."""
    rng = random.Random(9)
    lens = {"a": 100, "b": 64, "c": 16, "d": 1, "e": 33, "none": 0}
    frags = [("g", c, a, a + rng.choice([0, 1, 5, 16, 40]), rng.choice([None, 0.25, 0.5])) for c in [*lens, "lost"] for a in (rng.randrange(-20, 110) for _ in range(12))]
    df = spark.createDataFrame([*frags, (None, "a", 0, 9, 0.1)], "genome string, contig string, start long, end long, p double")
    contigs = spark.createDataFrame([("g", c, n) for c, n in [*lens.items(), ("e", 20)]], "genome string, contig string, len long")
    want = []
    for c, n in lens.items():
        runs = []
        for i in range(n):
            own = [p for _, k, a, b, p in frags if k == c and a <= i < b and p is not None]
            score = round(sum(own) / len(own), 12) - 0.5 if own else None
            if runs and runs[-1][2] == score:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1, score])
        want += [(c, *r) for r in runs]
    spelled = lambda x: sorted(map(str, ((r.contig, r.start, r.end, r.score) for r in x.collect())))
    for bits in (0, 4, 20):
        assert spelled(genome.genome_map(df, contigs, bits=bits)) == sorted(map(str, want))
    got = plan(genome.genome_map(df, contigs))
    assert got.count("Exchange ") == 1 and "Join" not in got


@pytest.mark.parametrize("name", ("agg_concord", "cls_pair"))
def test_scores_of_mates_are_made_once(spark, name):
    """Both sides of a join of mates read stored scores: no read is cut or counted twice."""
    assert "replace(" not in plan(QUERIES[name](spark, SF))


def test_maps_spell_no_fragments(spark):
    """Windows are counted along contigs, and what needs lengths only spells no contig."""
    got = plan(genomes._intervals(spark, SF))
    assert "rpad(" not in got and "MapInArrow" in got
    assert "ArrowEvalPython" not in plan(fixtures.features(spark, SF)) + plan(fixtures.contigs(spark, SF).select("len"))
    got = QUERIES["map_scores"](spark, SF)
    assert "decimal" not in plan(got) and got.count()


@pytest.mark.parametrize("piece", (1, 3, 1024))
def test_counts_of_windows_are_those_of_their_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(fragment, "PIECE", piece)
    monkeypatch.setattr(fragment, "COUNT", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGTN", k=n)) for n in (0, 1, 9, 10, 11, 14, 37, 200)] + [None]
    df = spark.createDataFrame([("g", i, t, None if t is None else len(t)) for i, t in enumerate(texts)], "genome string, contig long, seq string, len long").coalesce(1)
    want = [(*r[:5], None if r.seq is None else sum(b in "GC" for b in r.seq)) for r in fragment.fragment(df, 10, 4).collect()]
    got = fragment.fragment_counts(df, "GC", 10, 4)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 60
    with pytest.raises(ValueError):
        fragment.fragment_counts(df, "AN")


@pytest.mark.parametrize("records", (1, 2, 5))
def test_sweeps_go_on_over_arrow_batches(spark, records):
    """Sums, ties of places and runs go on from batch to batch, of scores of any size."""
    rng = random.Random(records)
    frags = [("g", rng.choice("ab"), a, a + rng.choice([1, 5, 40, 3000]), rng.choice([None, 0.25, 0.5, 1 / 3, -7.25, 3e9])) for a in (rng.randrange(-20, 60) * 7 for _ in range(80))]
    df = spark.createDataFrame(frags, "genome string, contig string, start long, end long, p double").repartition(3)
    contigs = spark.createDataFrame([("g", "a", 4000), ("g", "b", 350), ("g", "bare", 9), (None, "a", 5)], "genome string, contig string, len long")
    spelled = lambda bits: sorted(map(str, ((r.genome, r.contig, r.start, r.end, r.score) for r in genome.genome_map(df, contigs, bits=bits).collect())))
    want = spelled(20)
    scores = {}
    for c, n in (("a", 4000), ("b", 350)):
        for x in range(n):
            own = [p for _, k, a, b, p in frags if k == c and a <= x < b and p is not None]
            scores[c, x] = sum(own) / len(own) - 0.5 if own else None
    for r in genome.genome_map(df, contigs).where("genome is not null and contig <> 'bare'").collect():
        for x in range(r.start, r.end):
            assert scores[r.contig, x] == pytest.approx(r.score, rel=1e-12, abs=2e-12) if r.score is not None else scores[r.contig, x] is None
            del scores[r.contig, x]
    assert not scores
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        assert spelled(20) == spelled(5) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spelling_of_characters_of_several_bytes():
    texts = ["abcé😀Z-x", None, "", "héllo", "ß", "Zz"]
    want = [None if t is None else "".join(fixtures.CODE[fixtures.ALPHA.index(c)] if c in fixtures.ALPHA else "N" for c in t) for t in texts]
    for some, right in ((texts, want), (texts[3:], want[3:]), ([None], [None]), ([], [])):
        assert fixtures.spell(pa.array(some, pa.string())).to_pylist() == right
    assert fixtures.spell(pa.array(texts).slice(2)).to_pylist() == want[2:]


def test_scans_look_first_columns_up_together(spark):
    """Most places go by one lookup: of places that cannot reach the bias no column is added by itself."""
    weights = np.random.default_rng(1).normal(size=(4, 9))
    value, may, spared = motif.joint_scores(weights, 8.0)
    assert len(value) == 5**motif.JOINT and may.mean() < 0.1 and spared[~may].max() > 0
    letters = np.random.default_rng(2).integers(0, 5, 5000).astype(np.int8)
    codes = motif.joint_codes(letters, motif.JOINT)
    for at in (0, 17, 4000):
        right = -8.0
        for j in range(motif.JOINT):
            right += np.append(weights[:, j], 0.0)[letters[at + j]]
        assert value[codes[at]] == right


@pytest.mark.parametrize("lot", (1, 2, 64))
def test_scans_in_lots_of_filters_of_several_lengths(spark, monkeypatch, lot):
    monkeypatch.setattr(motif, "LOT", lot)
    rng = random.Random(lot)
    bank = {m: motif.one_hot_weights(m) for m in ("ACG", "GA", "TTACGTTA", "CCATGGA", "T")}
    texts = ["".join(rng.choices("ACGTN", k=n)) for n in (0, 1, 2, 7, 8, 30, 400)]
    texts += ["TTACGTTACCATGGA", None]
    df = spark.createDataFrame(list(enumerate(texts)), "read long, seq string").coalesce(1)
    for bias in (0.5, 1.5, 6.5):
        want = []
        for i, t in enumerate(texts):
            for f, w in bank.items():
                for s, v in (("+", w), ("-", w[::-1, ::-1])):
                    for p in range(len(t or "") - len(v) + 1):
                        x = sum(v[j]["ACGT".index(t[p + j])] if t[p + j] in "ACGT" else 0.0 for j in range(len(v))) - bias
                        want += [(i, f, s, p, x)] if x > 0 else []
        assert sorted(map(tuple, motif.motif_scan(df, bank, bias, ["read"]).collect())) == sorted(want) and want


@pytest.mark.parametrize("name", ("feat_score", "rank_genes", "enr_counts", "enr_fisher"))
def test_texts_are_not_read_for_lengths_again(spark, name):
    assert "documents.parquet" not in plan(QUERIES[name](spark, SF)).replace("...", "")
