"""Each numbered operator against a plain version: edge rows, the small tables, and its parts."""

import collections
import math
import os
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"
import brute  # noqa: E402

from helixframe.llm import (  # noqa: E402
    _components, _repeats, _runs, _tokens, decontamination, dual_tree, language, near_dedup, packing, secrets, simhash, substring_dedup, suffix_dedup, token_files, toxicity,
)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, dkey string, tkey int, body string, fp string, spans int, start int"


def key(row):
    return tuple((x is not None, x) for x in row)


def made_texts():
    """Nulls, empty and long texts, copies, near copies, shared passages, runs of one letter, ties."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(120), prose(300)
    docs = [None, "", " \n\t ", "x", "a" * 1500, "ab" * 700, base, base, base + " z", "Q " + base, prose(5000)]
    docs += [prose(rng.randint(1, 60)) + " " + passage + "\n" + prose(rng.randint(1, 60)) for _ in range(6)]
    docs += [" ".join(w if rng.random() > 0.01 else "EDIT" for w in base.split()) for _ in range(6)]
    docs += [passage + " " + passage, "  two  spaces,\n\nlines    x\r\n\ty 's <|endoftext|> don't 3.14 \U0001f600!", "A" * 500 + passage]
    docs += ["password = hunter22 token:'ab' AKIA" + "A1" * 9 + " secret=" + "0f" * 15 + " API_KEY=ſecret99 \U0001f600 passwd: abcdef"]
    docs += [prose(40) for _ in range(10)]
    rows = [(i * 7 - 3, t) for i, t in enumerate(docs)]
    return [*rows, rows[6], rows[3], (None, base), (None, "only here " + passage)]


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "k", 1, "b", "f", 2, 3) for d, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def same(df, want, n=None):
    got = sorted((tuple(r)[:n] for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


def test_op1_edges(docs, texts, empty):
    same(suffix_dedup.digest(suffix_dedup.remove_repeats(docs, bits=16)), brute.op1(texts))
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(empty, bits=16)).count() == 0


def test_op1_small_windows(docs, texts):
    same(suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 40, 10, 10, 3, 16)), brute.op1(texts, 40))


def test_op1_tables(spark, small):
    same(suffix_dedup.op1_suffix_dedup(spark, SF), brute.op1(small))


def test_hot_anchor_path(docs, texts, monkeypatch):
    monkeypatch.setattr(_repeats, "CLASS_LIMIT", 1)
    same(suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 40, 10, 10, 2, 16)), brute.op1(texts, 40))
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs, bits=16)), brute.op4(texts))


def test_copies_of_one_run_stay_in_their_tasks(spark):
    """A run with most of the rows is not dealt to one task; rarer copies and single runs are told apart as before."""
    run = "cast(case when id < 40000 then 1 when id < 44000 then id div 2 else id end as long)"
    rows = spark.range(0, 46_000, 1, 8).selectExpr(
        f"{run} % 3000 as kh", f"{run} as r1", f"{run} as r2", "id as dkey", "id as tkey", "id as start", "1 as n"
    )
    candidates = _repeats.materialise(rows.repartition(8), "runs")
    found = _repeats.classes(candidates)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the copied runs are too many to broadcast
    try:
        got = _repeats.whole_runs(candidates, found).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.start for r in got) == list(range(44_000))
    assert max(collections.Counter(r.task for r in got if r.start < 40_000).values()) < 20_000


def test_merged_transform_orders_all_suffixes():
    """The interleave of shard transforms is the order of all circular suffixes, prefixes included."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice([97, 98], n).astype(np.uint8)) for n in (40, 60, 44, 80)]
    symbol = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    at = np.concatenate([s + (np.arange(len(t)) - 1) % len(t) for s, t in zip(starts, texts)])
    depth = 12
    shards = [suffix_dedup.shard_transform(np.arange(a, b), symbol, at, depth) for a, b in ((0, 100), (100, 224))]
    interleave, prefix = suffix_dedup.merge_transforms(shards, depth)
    merged = np.empty(224, int)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate([s.order for s in shards])
    word = {}
    for s, t in zip(starts, texts):
        for i in range(len(t)):
            word[s + i] = bytes(t[(i + j) % len(t)] for j in range(depth))
    spelt = [word[i] for i in merged]
    assert spelt == sorted(word.values())
    for a, b, n in zip(spelt, spelt[1:], prefix[1:]):
        assert len(os.path.commonprefix([a, b])) == n


def test_runs_cover_all_windows():
    rng = np.random.default_rng(1)
    symbols = _runs.BYTE_SYMBOLS[rng.integers(0, 3, 5000)]
    covered = []
    for base, hasher, first, last, anchor in _runs.runs(symbols, 50, 20):
        assert (anchor >= last).all() and (anchor + 20 <= first + 50).all()
        covered += [base + i for a, b in zip(first, last) for i in range(a, b + 1)]
    assert covered == list(range(5000 - 50 + 1))


def test_op2_edges(docs, texts, empty):
    found = simhash.components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    same(found, brute.op2(texts))
    assert simhash.components(empty).count() == 0


def test_op2_tables(spark, small):
    same(simhash.op2_simhash(spark, SF), brute.op2(small))


def test_covering_masks_miss_no_pair():
    rng = random.Random(9)
    for level in range(3):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(4, level)]
        assert len(masks) == 31
        for _ in range(500):
            diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
            assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4, 1024])
def test_large_buckets_are_keyed_again(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    fps = list({rng.getrandbits(64) for _ in range(20)} | {sum(1 << i for i in rng.sample(range(12), 3)) for _ in range(80)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = _components.connected_components(simhash.covering_links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    got = dict(tuple(r) for r in roots.collect())
    want = brute.components(fps, signed, 4)
    assert [got.get(f, f) for f in signed] == want


def test_components_of_a_path(spark):
    n = 200
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7000, 7000)], "u long, v long")
    got = dict(tuple(r) for r in _components.connected_components(edges).collect())
    assert {got[i] for i in range(n)} == {0} and got[1001] == got[1000] == 1000


def test_op3_edges(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(240)]
    vectors += [(300, vectors[0][1]), (300, vectors[0][1]), (301, None), (302, [1.0, None, 2.0]), (303, [math.nan] * 6), (304, [math.inf] * 6), (400, [0.0] * 6), (500, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    real = [(r.vec_id, r.embedding) for r in df.collect()]
    prepared = df.where(dual_tree.usable(F.col("embedding"))).select("vec_id", dual_tree.quantised(F.col("embedding")).alias("v"))
    for k, pivots in ((10, 8), (3, 1)):
        same(dual_tree.top_k(prepared, F.col("vec_id") % 20 == 0, k, pivots), brute.op3(real, lambda i: i % 20 == 0, k))
    assert dual_tree.top_k(prepared.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_op3_large_cells_become_shells(spark, monkeypatch):
    """Cells of several shells, a shell of equal vectors that only a hash can part, few pivots and many."""
    monkeypatch.setattr(dual_tree, "CHUNK", 40)
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 20, (5, 4))
    rows = [(i, (centre[i % 5] + rng.normal(0, 0.1 + i % 7, 4)).tolist()) for i in range(400)] + [(400 + i, [3.0, 1.0, 2.0, 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    prepared = df.select("vec_id", dual_tree.quantised(F.col("embedding")).alias("v"))
    expected = brute.op3([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 20 == 0)
    for pivots in (1, 3, None):
        same(dual_tree.top_k(prepared, F.col("vec_id") % 20 == 0, pivots=pivots), expected)


def test_op3_chunks_cover_all_rows():
    Group = collections.namedtuple("Group", "cell shell n radius")
    groups = [Group(0, 3, 10, 5.0), Group(0, 1, 4, 1.0), Group(0, 2, 5, 2.0), Group(2, 7, 95, 9.0), Group(1, 1, 6, 3.0)]
    found = [(c, s, chunk, parts) for c, s, chunk, parts, _ in dual_tree.chunks_of(groups, np.array([1, 0, 2]), 10)]
    assert found == [(1, 1, 0, 1), (0, 1, 0, 1), (0, 2, 1, 1), (0, 3, 2, 1), (2, 7, 3, 10)]
    assert dual_tree.chunks_of([], np.array([0]), 10) == []
    near = dual_tree.neighbours_first(np.array([[0], [100], [1], [101], [2]]))
    assert sorted(near) == [0, 1, 2, 3, 4] and abs(near[1] - near[3]) == 1


def test_op3_prunes_and_stays_exact(monkeypatch):
    monkeypatch.setattr(dual_tree, "LEAF", 8)
    rng = np.random.default_rng(6)
    data = (rng.normal(0, 1, (20, 8))[rng.integers(0, 20, 600)] * 1000 + rng.normal(0, 5, (600, 8))).astype(np.int64)
    found = dual_tree.search(data[:50], np.arange(50), np.full(50, -np.inf), data, np.arange(600), np.arange(600), 5)
    for q in range(50):
        score = data @ data[q]
        want = [(int(score[i]), int(i)) for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        assert [(s, i) for a, i, s in found if a == q] == want


def test_op3_vectors_without_clusters_stay_together(monkeypatch):
    """A tree that no net covers closely is a leaf, not a node a vector; leaves are compared in blocks, ties and all."""
    rng = np.random.default_rng(7)
    assert len(dual_tree.CoverTree(rng.normal(0, 1000, (5000, 64))).first) < 100
    monkeypatch.setattr(dual_tree, "BLOCK", 7)
    monkeypatch.setattr(dual_tree, "ROWS", 90)
    data = np.concatenate([rng.normal(0, 30, (900, 16)), np.repeat(rng.normal(0, 30, (3, 16)), 100, axis=0), np.zeros((50, 16))]).astype(np.int64)
    ids = rng.permutation(len(data))
    of = np.r_[0:20, 900:905, 1000:1003, 1200:1204]
    found = dual_tree.search(data[of], of, np.full(len(of), -np.inf), data, np.arange(len(data)), ids, 10)
    for q, row in enumerate(of):
        score = data @ data[row]
        want = [(int(score[i]), int(ids[i])) for i in np.lexsort((ids, -score)) if i != row][:10]
        assert [(s, i) for a, i, s in found if a == q] == want


def test_op4_edges(docs, texts, empty):
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs, bits=16)), brute.op4(texts))
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs, bits=6)), brute.op4(texts))
    assert substring_dedup.digest(substring_dedup.remove_repeats(empty, bits=16)).count() == 0


def test_op4_tables(spark, small):
    same(substring_dedup.op4_substring_dedup(spark, SF), brute.op4(small))


def test_op5_edges(docs, texts, empty):
    packed = packing.pack(docs).withColumn("crc", F.crc32("ids")).cache()
    same(packed.select("doc_id", "piece", "start", "length", "crc"), brute.op5(texts))
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_open_bins_stay_bounded_and_full():
    rng = random.Random(8)
    bins, used = packing.OpenBins(2048, 64, 0), {}
    sizes = [rng.randint(1, 2048) if rng.random() < 0.3 else rng.randint(1, 700) for _ in range(20_000)]
    for n in sizes:
        sequence, offset = bins.place(n)
        assert used.get(sequence, 0) == offset and bins.count <= 64
        used[sequence] = offset + n
    assert max(used.values()) <= 2048 and sum(sizes) / (2048 * len(used)) > 0.97


def test_op6_edges(spark, docs, texts, empty, tmp_path):
    distinct = [t for i, t in enumerate(texts) if t[0] is not None and t not in texts[:i]]
    token_files.write_tokens(spark.createDataFrame(distinct, "doc_id long, text string"), path := str(tmp_path / "tokens"))
    same(token_files.token_index(token_files.read_tokens(spark, path)), brute.op6(distinct))
    token_files.write_tokens(docs, path := str(tmp_path / "all"))
    found = token_files.token_index(token_files.read_tokens(spark, path)).collect()
    assert len(found) == len(texts)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    token_files.write_tokens(empty, path := str(tmp_path / "none"))
    assert token_files.token_index(token_files.read_tokens(spark, path)).count() == 0


def test_encoder_equals_the_library(monkeypatch, texts):
    monkeypatch.setattr(_tokens, "CACHE", 20)
    monkeypatch.setattr(_tokens, "PART", 64)
    encoder = _tokens.Encoder(_tokens.default_path())
    rng = random.Random(7)
    noise = ["".join(rng.choice(" \n\tab.,'s1é 中") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    every = [t for _, t in texts] + noise
    for i in range(0, len(every), 9):
        got = encoder.encode(every[i : i + 9], 0)
        for a, (_, b) in zip(got, brute.token_ids([(0, t) for t in every[i : i + 9]], 0), strict=True):
            assert a.tolist() == b.tolist()


def test_op7(spark):
    rng = random.Random(1)
    bad, good = ["idiot", "moron", "stupid"], ["".join(rng.choice("aeioulnrt") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.05 else rng.choice(good) for _ in range(60)) + (" idiot" if toxic else "")
    labels = [(i, i % 4 == 0) for i in range(1200)]
    docs = spark.createDataFrame([(i, text(t)) for i, t in labels] + [(9001, None), (9002, ""), (9003, "idiots moronic stupidly " + text(False)[:80])], "doc_id long, text string")
    marked = spark.createDataFrame([(i, int(t)) for i, t in labels] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marked)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, t in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == t for i, t in held) / len(held) > 0.95
    assert got[9001] == got[9002] and 0 <= got[9001] <= 1
    assert got[9003] >= 0.5, "unseen forms share n-grams with the words they derive from"
    flipped = toxicity.fit(docs, marked.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(flipped.gram, model.gram), "fold 0 is never learned from"
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_op7_against_a_plain_version(spark, texts):
    rng = random.Random(4)
    bad, good = ["idiot", "moron", "stupid"], ["".join(rng.choice("aeioulnrt") for _ in range(rng.randint(2, 8))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(good) for _ in range(25)) + (" " + rng.choice(bad) + " IDIOT" if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame([*rows, (0, "~ a repeated id, later in byte order")], "doc_id long, text string").repartition(4)
    marked = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(3, 0)], "doc_id long, toxic int")
    buckets = 1 << 12
    model = toxicity.fit(docs, marked, buckets=buckets)
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    bags, labels = [brute.op7_bag(t, buckets) for _, t in learned], [int(i % 3 == 0) for i, _ in learned]
    known = brute.op7_known(bags, labels)
    gram, bias = brute.op7_train(bags, labels, known, toxicity.DIM, toxicity.SCALE, toxicity.RATE, toxicity.BATCH, toxicity.EPOCHS, toxicity.LEAST_BATCHES, 7)
    assert known and set(np.flatnonzero(model.gram)) == set(known)
    largest = max(map(abs, gram.values()))
    assert all(abs(model.gram[b] - x) < 0.02 * largest for b, x in gram.items()) and model.bias == pytest.approx(bias, rel=0.02)
    every = [*rows, *((1000 + i, t) for i, (_, t) in enumerate(texts)), (2000, "stupid " * 9999 + "x")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(every, "doc_id long, text string").repartition(3), model).collect()}
    assert got == {d: pytest.approx(brute.op7_score(t, model.gram, model.bias), abs=1e-6) for d, t in every}


def brute_language(rows, k, strength=5.0):
    """``rows`` are (page_id, host, suffix, declared, ll, soft)."""
    words = len({r[3] for r in rows})
    out = {}
    for page, host, suffix, declared, ll, soft in rows:
        def share(field, value, i):
            own = [r for r in rows if field is None or r[field] == value]
            return sum(r[5][i] for r in own) - soft[i], len(own) - 1

        total = []
        for i in range(k):
            n, of = share(None, None, i)
            prior, said = (n + 1) / (of + k), n
            for field, value in ((2, suffix), (1, host)):
                m, of = share(field, value, i)
                prior = (m + strength * prior) / (of + strength)
            m, _ = share(3, declared, i)
            total.append(ll[i] + math.log(max(prior, 1e-9)) + math.log(max((m + 1) / (said + words), 1e-9)))
        best = max(total)
        out[page] = total.index(best), 1 / sum(math.exp(t - best) for t in total)
    return out


def test_op8(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    odd = [(-1, None, None), (-2, "", ""), (-3, "http://h.example.de:80/x?y", "<html LANG='DE-at'><body></body>"), (-4, "no address", "<p>the and of</p>")]
    pages = pages.select("page_id", "url", "html").union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    languages, model = language.fit(docs)
    assert languages == sorted(languages) and model.shape == (len(languages), language.BUCKETS)
    rows = [tuple(r) for r in language.likelihoods(pages, languages, model).collect()]
    assert {r[0]: r[1:4] for r in rows}[-3] == ("h.example.de", "de", "de")
    want = brute_language(rows, len(languages))
    found = language.identify(pages.withColumn("lang", F.lit("x")).withColumn("soft", F.lit(1)), languages, model).collect()
    assert len(found) == len(rows) == len(want)
    for r in found:
        best, confidence = want[r.page_id]
        assert r.lang == languages[best] and r.confidence == pytest.approx(confidence, rel=1e-6)
    assert language.identify(pages.limit(0), languages, model).count() == 0
    held = docs.where("lang is not null").selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html", "lang as truth")
    guess = language.identify(held, languages, model).join(held.select("page_id", "truth"), "page_id")
    assert guess.where("text_lang = truth").count() / guess.count() > 0.95


def test_op8_against_a_plain_version(spark, texts):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    named = [(r.doc_id, r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()]
    odd = [(-1 - i, f"http://x.org/{i}", t) for i, (_, t) in enumerate(texts)] + [(-1000, "", "<html lang=fr><p>wrong</p><style>p{}</style>the and of")]
    pages = pages.select("page_id", "url", "html").limit(150).union(spark.createDataFrame(odd, "page_id long, url string, html string")).cache()
    languages, model = language.fit(docs.unionByName(docs.limit(20)), per_language=1000)
    plain = brute.op8_fit(named, language.BUCKETS)
    assert languages == list(plain)
    for row, (own, none) in zip(model, plain.values(), strict=True):
        want = np.full(language.BUCKETS, none)
        want[list(own)] = list(own.values())
        assert np.allclose(row, want, rtol=1e-9)
    found = {r.page_id: (r.ll, r.soft) for r in language.likelihoods(pages, languages, model).collect()}
    for r in pages.collect():
        ll, soft = brute.op8_likelihoods(r.html, plain, language.BUCKETS)
        assert found[r.page_id] == (pytest.approx(ll, abs=1e-6), pytest.approx(soft, abs=1e-6))
    pages.unpersist()


def test_op8_held_out_with_wrong_markup(spark):
    """Half the documents are learned from; of the others' pages, three in ten declare a wrong language and four in ten none."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").where("lang is not null and text is not null")
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(n))
    languages, model = language.fit(docs.where(draw("half", 2) == 0))
    names = F.array(*map(F.lit, languages))
    other = F.element_at(names, (F.pmod(F.array_position(names, F.col("lang")), F.lit(len(languages))) + 1).cast("int"))
    held = docs.where(draw("half", 2) == 1).withColumn("d", draw("markup", 10)).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), draw("host", 20), F.lit(".org/")).alias("url"), F.col("lang").alias("truth"), (F.col("d") < 3).alias("wrong"),
        F.concat(F.when(F.col("d") < 3, F.concat(F.lit("<html lang="), other, F.lit(">"))).when(F.col("d") < 6, F.concat(F.lit("<html lang="), F.col("lang"), F.lit(">"))).otherwise("<html>"), F.col("text")).alias("html"),
    )
    rows = language.identify(held, languages, model).join(held.select("page_id", "truth", "wrong"), "page_id").collect()
    for some in (rows, [r for r in rows if r.wrong]):
        assert some and sum(r.lang == r.truth for r in some) / len(some) > 0.95
        assert sum(r.text_lang == r.truth for r in some) / len(some) > 0.95


def test_op9_edges(spark, docs, texts, empty):
    ledger = secrets.new_ledger(spark)
    secrets.scan_unseen(docs, ledger)
    found = secrets.findings(docs, ledger).collect()
    want = sorted(brute.op9(texts), key=key)
    got = []
    for r in found:
        base = [s for s in r.spans if s["kind"] in secrets.BASE]
        got.append((r.doc_id, *(sum(s["kind"] == k for s in base) for k in secrets.BASE), brute.sha(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base))))
    assert sorted(got, key=key) == want
    blobs = spark.read.parquet(ledger)
    n = blobs.count()
    assert n == blobs.select("blob").distinct().count() == len({t or "" for _, t in texts})
    secrets.scan_unseen(docs, ledger)
    assert spark.read.parquet(ledger).count() == n, "a second run scans nothing"
    secrets.scan_unseen(docs, ledger, secrets.RULES[:2])
    assert spark.read.parquet(ledger).count() == 2 * n, "new rules scan all blobs again"
    assert secrets.findings(empty, ledger).count() == 0


def test_op9_tables(spark, small):
    same(secrets.op9_secrets(spark, SF), brute.op9(small), 5)


def items_of(texts):
    long = [t for _, t in texts if t and len(t.split()) > 100]
    return [(1, long[0]), (20, " ".join(long[1].split()[5:12])), (3, " ".join(long[-1].split()[:30]).upper()), (4, None), (5, "!!"), (6, "x"), (7, "absent words only here")]


def test_op10_edges(spark, docs, texts, empty, monkeypatch):
    items = items_of(texts)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = sorted(((d, n, h, k) for d, n, h, k, _, _ in brute.op10(texts, items)), key=key)
    for words, block in ((decontamination.SEGMENT_WORDS, 1 << 20), (200, 1 << 20), (200, 40)):
        monkeypatch.setattr(decontamination, "SEGMENT_WORDS", words)
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = [(r.doc_id, r.n_words, sum(h["end"] - h["start"] for h in r.hits), len(r["items"])) for r in decontamination.matches(docs, bench).collect()]
        assert sorted(got, key=key) == want
    assert decontamination.matches(empty, bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_op10_proximity(spark, monkeypatch):
    words = [f"w{i}" for i in range(10)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([words[0], "gap", *words[1:]])), (3, "w0 " + "far " * 20 + "w1")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    bench = bench.union(spark.createDataFrame([(6, "other words here")], "item_id long, text string"))
    for block in (decontamination.BLOCK_BYTES, 8):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = {r.doc_id: (r["items"], r.near) for r in decontamination.matches(docs, bench, slop=3).collect()}
        assert got[1] == ([5], []) and got[2] == ([], [5]) and got[3] == ([], [])


def test_op10_tables(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(decontamination.op10_decontamination(spark, SF), brute.op10(small, items))


def test_near_dedup_keeps_one_of_each_group(spark, docs, texts):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    base = [d for d, t in texts if t and t == texts[6][1]]
    assert sum(d in base for d in ids if d is not None) == 1 and min(b for b in base if b is not None) in ids
    lone = [d for d, t in texts if t and len(t.split()) == 40]
    assert set(lone) <= set(ids)


def passages(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def resemblance_groups(texts):
    """Brute force: five-word shingle sets of all pairs at 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in texts]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    found = {}
    for (d, _), r in zip(texts, root, strict=True):
        found.setdefault(r, set()).add(d)
    return {frozenset(g) for g in found.values()}


def test_near_dedup_decides_on_exact_resemblance(spark):
    rng = random.Random(6)
    texts = []
    for share in (0.5, 0.7, 0.76, 0.84, 0.9, 0.97):
        for _ in range(6):  # a long passage shared by texts with ends of their own
            base, n = passages(rng, 100), round(100 * (1 - share) / (2 * share))
            texts += [" ".join([*passages(rng, n), *base, *passages(rng, n)]) for _ in range(3)]
    base = passages(rng, 200)
    texts += [" ".join(base[i : i + 120]) for i in range(0, 60, 4)]  # a chain of links
    for _ in range(5):
        base = passages(rng, 300)
        texts += [" ".join("edit" if i in at else w for i, w in enumerate(base)) for at in ([], *(rng.sample(range(300), 8) for _ in range(12)))]
    texts += ["", " ", "one two", "one two three", "One  two", *(" ".join(["same", "words"] * k) for k in (3, 4, 40))]
    texts = list(enumerate(texts))
    found = {}
    for r in near_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    assert {frozenset(g) for g in found.values()} == resemblance_groups(texts)


def test_near_dedup_rare_shingles_miss_no_pair(spark):
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 40, 60).tolist()
    sets = [rng.choice(80, int(rng.integers(1, 40)), replace=False).tolist() for _ in range(60)]
    for size in range(5, 20):  # a common passage, ends shared by two
        end = rng.integers(0, 1 << 40, size).tolist()
        sets += [passage + end, passage + end[1:], passage[2:] + end]
    sets += [[x for x in s if x != s[0]] or [1] for s in sets[:40]] + [sets[0][:1], []]
    sets = [sorted(set(map(int, s))) for s in sets]
    roots = [i // 2 for i in range(len(sets))]
    nodes = spark.createDataFrame([(i, len(s), r) for i, (s, r) in enumerate(zip(sets, roots))], "node long, n int, root long")
    table = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    pairs = near_dedup.rare_pairs(nodes, table, 0.8)
    got = {(r.u, r.v) for r in near_dedup.alike(pairs, table, 0.8).collect()}
    want = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
        if roots[i] != roots[j] and sets[i] and sets[j] and len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}) - 1e-9
    }
    assert got == want and len(want) > 20
    assert near_dedup.rare_pairs(nodes.limit(0), table, 0.8).isEmpty()


def test_near_dedup_uses_bands_of_every_text(spark):
    rng = random.Random(8)
    base, lone = passages(rng, 91), [" ".join(passages(rng, 60)) for _ in range(6)]
    # repeats outweigh the ends, so all fingerprints of whole texts agree, but not their shingles
    texts = [" ".join(base * 60 + [tail]) for tail in lone] + [" ".join([*base, *tail.split()]) for tail in lone]
    texts = list(enumerate(texts))
    assert len({simhash.fingerprint(t.encode(), near_dedup.SHINGLE) for _, t in texts[:6]}) == 1
    found = {}
    for r in near_dedup.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    assert {frozenset(g) for g in found.values()} == resemblance_groups(texts)


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    names = ["text", "row", "__row", "__", "dkey", "tkey", "__key", "body", "doc_id", "score", "spans", "masked", "n chars", "segment", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", *(F.lit(c).alias(c) for c in names[1:8]), "doc_id", *(F.lit(c).alias(c) for c in names[9:14]), "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        for row in docs.collect():
            assert all(row[c] == c for c in names if c not in ("text", "doc_id", "n_chars")) and row.n_chars == len(row.text)


def test_pipeline_of_edge_rows_and_of_none(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30_000, None, None, 150_000)], docs.schema)):
        held, empty = rows, rows.isEmpty()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, SF)
            assert held.columns == docs.columns and held.isEmpty() == empty, name
        assert {r.doc_id for r in held.collect()} == (set() if empty else {1, 2})
        assert corpus_pipeline.STAGES[-1][1](spark, held, SF).isEmpty() == empty


def test_op10_blocks_hold_one_at_a_time(spark, docs, texts, monkeypatch):
    """Many blocks give the rows of one, and each block's broadcast is gone before the next."""
    items = [(i, " ".join(t.split()[:40])) for i, (_, t) in enumerate(texts) if t and len(t.split()) > 12] + [(900, None), (901, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    look, alive, most = decontamination._look_up, [], []

    def watched(*args):
        part, sent = look(*args)
        destroy = sent.destroy
        sent.destroy = lambda: (alive.remove(1), destroy())
        alive.append(1)
        most.append(len(alive))
        return part, sent

    tidy = lambda df: sorted((tuple(r) for r in df.select("doc_id", "n_words", F.to_json("hits"), F.to_json("items"), F.to_json("near")).collect()), key=key)
    one = tidy(decontamination.matches(docs, bench, 5, 2))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    monkeypatch.setattr(decontamination, "_look_up", watched)
    assert tidy(decontamination.matches(docs, bench, 5, 2)) == one
    assert len(most) > 3 and set(most) == {1} and not alive


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = near = stage(spark, docs, SF).cache()
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name != "best-fit packing":
            assert out.columns == names and 0 < out.count() <= before
        if name == "benchmark decontamination":
            clean = {d for d, *_, hit in brute.op10(rows, items) if not hit}
            assert {r.doc_id for r in out.collect()} == clean
        if name == "secret scans":
            assert out.count() == docs.count()
            found = {d: n for d, *n, _ in brute.op9([(r.doc_id, r.text) for r in out.collect()])}
            assert not any(sum(n) for n in found.values())
            marked = {d for d, *n, _ in brute.op9(rows) if sum(n)}
            text = dict(rows)
            assert all((r.text == text[r.doc_id]) == (r.doc_id not in marked) for r in out.collect())
        if name == "best-fit packing":
            same(near.select("doc_id", "piece", "start", "length", "ids_crc32"), brute.op5(rows))
        docs, before = out, out.count()


def test_extra_columns_and_registration():
    from helixframe.llm import queries

    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_dual_tree", "op4_substring_dedup", "op9_secrets", "op10_decontamination", "op12_prefix_trie", "op13_metric_join"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    from helixframe.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, result = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    same(df.select(*names), result.fetchall())


def test_repeated_rows_and_one_letter_texts(spark):
    """What is collected for a text does not grow with its copies or with runs that touch."""
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300))
    texts = [(1, text)] * 2000 + [(2, "a" * (1 << 20)), (3, "lone " + text[:90])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, bits=16)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(tuple(r) for r in found) == [(1, len(text), len(text), 1)] * 2000 + [(2, 1 << 20, 1 << 20, 1), (3, 95, 0, 0)]
    found = substring_dedup.digest(substring_dedup.remove_repeats(docs, bits=16)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(tuple(r) for r in found) == [(1, 300, 300)] * 2000 + [(2, 1, 0), (3, 16, 0)]


def test_op3_and_op5_tables(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(dual_tree.op3_dual_tree(spark, SF), brute.op3(rows, lambda i: i % 100 == 0))
    packed = packing.op5_packing(spark, SF).cache()
    same(packed.select("doc_id", "piece", "start", "length", "ids_crc32"), brute.op5(small))
    total = packed.agg(F.sum("length")).first()[0]
    assert packed.select("sequence_id").distinct().count() <= 1.1 * -(-total // 2048) + 2


def test_op6_table_and_pruned_reads(spark, small, tmp_path):
    same(token_files.op6_token_files(spark, SF), brute.op6(small))
    many = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('w ', id) as text").coalesce(1)
    token_files.write_tokens(many, path := str(tmp_path / "many"))
    for wanted, rows in ((20_000, 1), (20_001, 0)):  # within the ids' range, one of them absent
        found = token_files.find_documents(spark, path, [wanted])
        assert len(found.collect()) == rows
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert read <= 2 * int(token_files.ORC_OPTIONS["orc.row.index.stride"])


def test_op7_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for labels, low in (([], True), ([(1, None)], True), ([(1, 0)], True), ([(1, 1)], False)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all((r.score < 0.01) == low for r in toxicity.score(docs, model).collect())


def test_op8_without_languages(spark):
    docs = spark.createDataFrame([(1, None, "x")], "doc_id long, lang string, text string")
    languages, model = language.fit(docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = language.identify(pages, languages, model)
    assert languages == [] and found.count() == pages.count() == found.where("lang is null").count()
