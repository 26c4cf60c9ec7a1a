"""Whitening, prefix trie and metric join against plain versions: edge rows, hot groups, the small tables."""

import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"
import brute  # noqa: E402

from helixframe.llm import metric_join, prefix_trie, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row long, x string"
TURNS = "conv_id long, turn long, role string, text string, node string"


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small tables too are spread over several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def made_vectors(n=300, d=12, groups=6, spread=0.05, seed=3):
    """Noise, tight groups with one of a third of all rows, repeats, scaled copies, rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, d))
    centres = rng.standard_normal((groups, d))
    for i in range(n // 2):
        rows[i] = centres[0 if i < n // 3 else i % groups] + spread * rng.standard_normal(d)
    chain = [np.r_[np.cos(0.2 * i), np.sin(0.2 * i), np.zeros(d - 2)] for i in range(9)]
    every = [*rows.astype(np.float32).tolist(), *np.float32(chain).tolist()]
    every += [every[0], every[0], [3 * x for x in every[1]], [0.0] * d, every[5][:4], []]
    named = [(i * 3 + 1, v) for i, v in enumerate(every)]
    named += [(7, None), (8, [1.0, None] + [0.0] * (d - 2)), (9, [float("nan")] * d), (None, every[2]), (1, every[-3]), (10, [float("inf")] * d)]
    rng.shuffle(named)
    return [(i, None if v is None else list(v)) for i, v in named]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "x") for i, v in rows], VECTORS).repartition(3)


def whitened_like(df, rows, k=16):
    n, ids, deviation, values, explained = brute.op11(rows, k)
    got = df.collect()
    assert len(got) == len(ids) * values.shape[1]
    assert {(r.n, r.identity_error < 1e-9, r.residual < 1e-10) for r in got} == {(n, True, True)}
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    for c in range(values.shape[1]):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is not None, r.vec_id, r.deviation, abs(r.whitened)))
        want = sorted(zip(ids, deviation, values[:, c], strict=True), key=lambda r: (r[0] is not None, r[0], r[1], abs(r[2])))
        assert [(r.vec_id, r.deviation) for r in own] == [(i, x) for i, x, _ in want]
        a, b = np.array([r.whitened for r in own]), np.array([x for *_, x in want])
        assert np.abs(a - b * np.sign(a @ b)).max() < 1e-8 * np.abs(b).max()


def test_op11_edges(spark):
    rows = made_vectors()
    whitened_like(whitening.whiten(frame(spark, rows)), rows)
    whitened_like(whitening.whiten(frame(spark, rows), k=3, block=5, degree=6), rows, 3)


def test_op11_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = made_vectors(d=6)
    whitened_like(whitening.whiten(frame(spark, rows), k=2), rows, 2)


def test_op11_low_rank_and_large(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x), float(2 * x), 5.0]) for i, x in enumerate(rng.integers(-9, 9, 50))]
    whitened_like(whitening.whiten(frame(spark, rows)), rows)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    wide = whitening.whiten(frame(spark, [(1, [1e30, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 3.0])])).collect()
    assert all(r.deviation is None for r in wide if r.vec_id == 1)


def test_op11_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    whitened_like(whitening.op11_whitening(spark, SF), rows)


def test_op11_filter_is_used(spark):
    """A block smaller than the space converges by filtered rounds, and says so."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors, d, kind = whitening.packed(rows)
    found = whitening.spectrum(whitening._blocks(vectors), d, kind)
    assert found.passes > whitening.DEGREE and found.residual <= whitening.CERTIFIED


def made_turns(n=60, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "é\U0001f600", "", None, "b" * 200])))
    for c in range(1000, 1000 + n):  # a common conversation
        rows += [(c, t, "user", f"common {t}") for t in range(10)]
    rows += [(505, t, "user", str(t)) for t in range(300)]  # a long chain
    rows += [(-7, 0, "user", "x"), (-5, 0, "user", "y"), (None, 0, "user", "z"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], TURNS).repartition(3)


def counted(turns):
    """The query's columns for a DataFrame of turns."""
    rows, sequences = prefix_trie.rebuilt(turns)
    return prefix_trie.digested(rows, sequences)


def test_op12_edges(spark):
    rows = made_turns()
    same(counted(turns_frame(spark, rows)), brute.op12(rows))


def test_op12_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = made_turns(30)
    same(counted(turns_frame(spark, rows)), brute.op12(rows))


def test_op12_turnless_and_empty(spark):
    rows = [(c, 0, "user", str(c)) for c in range(1, 30)]  # many have no turn left, and no first conversation
    same(counted(turns_frame(spark, rows)), brute.op12(rows))
    assert counted(turns_frame(spark, [])).count() == 0
    assert counted(turns_frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_op12_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(prefix_trie.op12_prefix_trie(spark, SF), brute.op12(rows))


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "forest"])
def test_contraction(spark, shape):
    n, rng = 200, random.Random(6)
    parent = {
        "chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2),
        "forest": lambda i: i - 3 if i > 2 else None,
    }[shape]
    up = {i: (parent(i) if i else None) for i in range(n)}
    depth, kids = {}, {i: 0 for i in up}
    for i, p in up.items():
        depth[i] = 0 if p is None else depth[p] + 1
        if p is not None:
            kids[p] += 1
    value = {i: rng.randrange(100) for i in up}
    want = dict(value)
    for i in reversed(range(n)):
        if up[i] is not None:
            want[up[i]] += want[i]
    tree = spark.createDataFrame([(i, up[i], depth[i], kids[i], value[i]) for i in up], "node long, parent long, depth long, n_children long, v long")
    assert {r.node: r.v for r in prefix_trie.subtree_totals(tree, ["v"]).collect()} == want


def test_op13_edges(spark):
    rows = made_vectors()
    same(metric_join.near_duplicates(frame(spark, rows)), brute.op13(rows))
    same(metric_join.near_duplicates(frame(spark, rows), 0.8, pivots=5, bin_size=16), brute.op13(rows, 0.8))
    same(metric_join.near_duplicates(frame(spark, rows), 0.95, pivots=3, bin_size=10), brute.op13(rows))


@pytest.mark.parametrize("spread", [0.02, 0.3, 1.0])
def test_op13_spreads(spark, spread):
    rows = made_vectors(400, 5, 4, spread, 9)
    same(metric_join.near_duplicates(frame(spark, rows), pivots=12, bin_size=40), brute.op13(rows))


def test_op13_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(metric_join.op13_metric_join(spark, SF), brute.op13(rows))


def test_op13_hot_group_is_not_compared(spark):
    """Members of a core link by its count: no pair of them is compared or written."""
    rng = np.random.default_rng(2)
    hot = (np.eye(1, 8) + 0.01 * rng.standard_normal((900, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(hot)]
    _, n_links, links = metric_join.near_links(frame(spark, rows))
    assert links.count() < 2 * len(rows)
    assert {r.n_links for r in n_links.collect()} == {899}


def test_op13_empty(spark):
    assert metric_join.near_duplicates(frame(spark, [])).count() == 0
    same(metric_join.near_duplicates(frame(spark, [(4, None), (5, [0.0]), (None, [1.0])])), [(4, 0, 4, True), (5, 0, 5, True), (None, 0, None, False)])


def test_spanning_links_reach_all():
    rng = np.random.default_rng(0)
    for _ in range(20):
        hit = rng.random((15, 20)) < 0.08
        u, v = metric_join._spanning(hit, np.arange(15), np.arange(100, 120))
        label = {x: x for x in [*range(15), *range(100, 120)]}
        find = lambda x: x if label[x] == x else find(label[x])  # noqa: B023, E731
        for a, b in zip(u, v, strict=True):
            label[find(a)] = find(b)
        for i, j in zip(*np.nonzero(hit), strict=True):
            assert find(i) == find(100 + j)


def test_decided_in_double():
    a = np.eye(2, 4)[:1]
    at = lambda c: np.array([[c, np.sqrt(1 - c * c), 0, 0]])
    assert metric_join.linked(a, at(0.95 + 1e-9), 0.95).all() and not metric_join.linked(a, at(0.95 - 1e-9), 0.95).any()
