import numpy as np
from lexgraph.llm import boosting


def test_learns_what_single_cuts_cannot():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:3000], y[:3000])
    hit = (model.raw(x[3000:]) > 0) == (y[3000:] > 0)
    assert hit.mean() > 0.95


def test_constant_features_and_labels():
    x = np.ones((50, 3))
    assert np.allclose(boosting.fit(x, np.ones(50), rounds=3).raw(x[:2]), boosting.fit(x, np.ones(50), rounds=3).raw(x[2:4]))
    assert (boosting.fit(x, np.zeros(50), rounds=3).raw(x) < -3).all()


def test_trees_grow_along_the_best_gain_as_a_plain_search_has_it():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) > 3).astype(float)
    (feature, cut, _), *_ = boosting.fit(x, y, rounds=1, depth=1).trees
    p = y.mean()
    g, h, best = y - p, np.full(300, p * (1 - p)), (0, 0, 0)
    for f in range(4):
        for c in np.unique(x[:, f]):
            left = x[:, f] <= c
            if h[left].sum() >= 1.25 and h[~left].sum() >= 1.25:
                best = max(best, (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1), f, c))
    assert (feature[0], cut[0]) == best[1:]
