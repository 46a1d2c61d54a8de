import random

import numpy as np
import pytest
from lexgraph.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<double>, label int, _vec string, n_links string"


def made(n=900, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(n // 3):
        x[k] = x[rng.integers(0, 20)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.3])
    return x


def brute(x, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], 1 << 60).min(axis=1))
        if (new == low).all():
            return near.sum(axis=1), low
        low = new


def test_recall_and_components(spark):
    x = made()
    rows = [(i, v.tolist(), 0, "x", "x") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in e.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    links, low = brute(x, range(len(x)))
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum() and links.sum() > 1000
    assert all(got[i].component_id >= low[i] and got[i].kept == (got[i].component_id == i) for i in got)


@pytest.mark.parametrize("cosine", [0.96, 0.98])
def test_recall_with_a_third_of_the_rows_in_one_group(spark, cosine):
    n, dim, rng = 3000, 64, np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[: n // 3] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(n // 3, dim)) * np.sqrt((1 / cosine - 1) / dim)
    got = {r.vec_id: r for r in e.near_vectors(spark.createDataFrame([(i, v.tolist(), 0, "x", "x") for i, v in enumerate(x)], SCHEMA)).collect()}
    links, _ = brute(x, range(n))
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum() and links.sum() > 100_000


def test_small_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist(), 0, "x", "x") for i, v in enumerate(made(300))], SCHEMA)
    monkeypatch.setattr(e, "WITHOUT", 50)
    once = sorted(map(tuple, e.near_vectors(df).collect()))
    monkeypatch.setattr(e, "LIST_BLOCK", 3)
    assert sorted(map(tuple, e.near_vectors(df).collect())) == once


def test_odd_vectors(spark):
    v = [random.Random(1).gauss(0, 1) for _ in range(8)]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (2, v), (3, [2 * a for a in v]), (4, [-a for a in v]), (5, None), (6, []), (7, [0.0] * 8), (8, [*v[:7], None]), (9, [*v[:7], nan]), (10, [*v[:7], inf]), (11, v[:7]), (None, v), (2, v), (12, [1e300 * a for a in v]), (13, [1e-300 * a for a in v]), (14, [-0.0, *[0.0] * 7])]
    got = e.near_vectors(spark.createDataFrame([(i, w, 0, "x", "x") for i, w in rows], SCHEMA)).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr)
    linked = [1, 2, 2, 3, 12, 13, None]
    want = [(i, 6, 1, i == 1) for i in linked] + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 14)]
    assert found == sorted(want, key=repr)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 0, "x", "x")]])
def test_few_rows(spark, rows):
    got = e.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.n_links, r.component_id) for r in got] == [(0, r[0]) for r in rows]


def test_every_length_is_indexed(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(2, 72):
        v = rng.normal(size=n)
        rows += [(2 * n, v.tolist(), 0, "x", "x"), (2 * n + 1, (v + 0.01 * rng.normal(size=n)).tolist(), 0, "x", "x")]
    got = e.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, 1, k // 2 * 2) for k in range(4, 144)]


def test_a_pair_is_taken_up_in_one_of_its_lists():
    rng = np.random.default_rng(8)
    x = e.unit(np.ones((60, 4)) + 0.01 * rng.normal(size=(60, 4)))
    orders = np.stack([rng.permutation(11)[:8] for _ in range(60)]).astype(np.int64)
    lists = {}
    for node, order in enumerate(orders):
        for i in range(1, 8):
            for j in range(i + 1, 8):
                lists.setdefault(tuple(sorted(order[[0, i, j]].tolist())), []).append(node)
    taken, slow = [], []
    for triple, nodes in lists.items():
        key, nodes = int(e.key_of(4, 0, np.array([triple]))[0]), np.array(nodes)
        a, b = e.first_close(x[nodes], orders[nodes], key, None, 0.9)
        taken += [tuple(sorted(t)) for t in zip(nodes[a].tolist(), nodes[b].tolist(), strict=True)]
        a, b = np.triu_indices(len(nodes), 1)
        first = e.lowest_key(orders[nodes[a]], orders[nodes[b]]) == key & 0xFFFFFFFFFFFF
        slow += [tuple(sorted(t)) for t in zip(nodes[a[first]].tolist(), nodes[b[first]].tolist(), strict=True)]
    want = []
    for a in range(60):
        for b in range(a + 1, 60):
            shared = set(orders[a].tolist()) & set(orders[b].tolist())
            if len(shared) >= 3 and {int(orders[a, 0]), int(orders[b, 0])} <= shared:
                want.append((a, b))
    assert sorted(taken) == want and sorted(slow) == want


def test_single_precision_is_kept(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.2, 0.4]), (3, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links) for r in e.near_vectors(df).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_several_sets_count_each_pair_once(spark, monkeypatch):
    x = made(1200, 16, 8)
    df = spark.createDataFrame([(i, v.tolist(), 0, "x", "x") for i, v in enumerate(x)], SCHEMA)
    links, _ = brute(x, range(len(x)))
    sums = []
    for sets in (1, 3):
        monkeypatch.setattr(e, "n_sets", lambda pivots, sets=sets: sets)
        for long in (48, 5):
            monkeypatch.setattr(e, "LONG_LIST", long)
            found = {r.vec_id: r.n_links for r in e.near_vectors(df).collect()}
            found = np.array([found[i] for i in range(len(x))])
            assert (found <= links).all()
            sums.append(found.sum())
    assert sums[0] == sums[1] and sums[2] == sums[3] and sums[0] <= sums[2] <= links.sum() and sums[2] >= 0.99 * links.sum()


@pytest.mark.parametrize("vectors", [10**5, 10**7, 10**9])
def test_recall_at_the_limit_by_size(vectors):
    """Pairs at the limit itself, among as many pivots as that many vectors get; random directions, the hardest case."""
    pivots, dim, rng = e.n_pivots(vectors), 64, np.random.default_rng(11)
    a = e.unit(rng.normal(size=(1000, dim)))
    side = rng.normal(size=a.shape)
    side = e.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    sets = e.n_sets(pivots)
    points = [e.spread(e.unit(rng.normal(size=(e.SAMPLED * pivots, dim))), pivots, 0.85) if pivots < 2000 else e.unit(rng.normal(size=(pivots, dim))) for _ in range(sets)]
    orders = [np.concatenate([np.argsort(-(x @ p.T), axis=1)[:, : e.NEAREST] for p in points], axis=1) for x in (a, b)]
    found = e.taken_before(*orders, sets)
    assert found.mean() >= 0.95, (vectors, pivots, found.mean())
    print(vectors, pivots, sets, found.mean())
