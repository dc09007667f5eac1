import random

import numpy as np
import pytest

from textloom.operators import classifier, quantiles


@pytest.mark.parametrize("few, buckets", [(4096, 1024), (3, 4)])
def test_quantiles_equal_sorting(table, monkeypatch, few, buckets):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    pick = random.Random(1)
    rows = [(pick.choice(["a", "b", None]), pick.choice([pick.gauss(0, 1), float(round(pick.gauss(0, 3))), 1e-300, 5.0])) for _ in range(400)]
    rows += [("one", 2.5), ("none", None), ("nan", float("nan")), ("two", -1e308), ("two", 1e308), ("same", 7.0), ("same", 7.0), ("low", float("-inf")), *[("low", -float(k)) for k in range(1, 8)], ("edge", float("inf")), ("edge", 1.0), ("edge", 2.0)]
    wanted = [0.0, 0.25, 0.5, 0.975, 1.0]
    got = {(r.g, r.q): r.value for r in quantiles.quantiles(table("g string, v double", rows), ["g"], "v", wanted).collect()}
    for g in ("a", "b", None, "one", "same"):
        v = sorted(x for h, x in rows if h == g)
        for q in wanted:
            assert got[g, q] == pytest.approx(np.percentile(v, 100 * q), rel=1e-12, abs=1e-12)
    assert got["two", 0.5] == 0 or got["two", 0.5] == pytest.approx(0, abs=1e300)
    assert got["edge", 0.5] == 2.0 and got["edge", 1.0] == float("inf")
    assert got["low", 0.5] == -4.5 and got["low", 1.0] == -1.0
    assert {g for g, _ in got} == {"a", "b", None, "one", "two", "same", "edge", "low"}


def test_quantiles_without_a_group_and_of_nothing(table):
    assert [r.value for r in quantiles.quantiles(table("v int", [(1,), (2,), (None,), (9,)]), [], "v", [0.5]).collect()] == [2.0]
    assert quantiles.quantiles(table("g int, v int", []), ["g"], "v", [0.5]).collect() == []


ROWS = "k long, x array<double>, y int, p double"


def labelled(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.5, -1.0, 0.0] + rng.normal(size=n) > 0.3).astype(int)
    return [(k, x[k].tolist(), int(y[k]), 9.0) for k in range(n)]


def newton(x, y, penalty):
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, (y - p) @ x - ridge @ w)
    return w


def test_folds_equal_fits_of_their_own(table):
    rows = labelled(2, 300) + [(None, [1.0, 1.0, 1.0], 1, 0.0), (900, None, 1, 0.0), (901, [1.0, None, 0.0], 1, 0.0), (902, [1.0, 1.0, 1.0], None, 0.0)]
    out = classifier.out_of_fold(table(ROWS, rows), "k", "x", "y", 4, 0.5).collect()
    fold, data = {r.k: r.fold for r in out}, {k: (x, y) for k, x, y, _ in rows[:300]}
    assert set(fold) == set(range(300)) and set(fold.values()) == {0, 1, 2, 3}
    for f in range(4):
        others = [k for k in data if fold[k] != f]
        w = newton(np.array([data[k][0] for k in others]), np.array([data[k][1] for k in others]), 0.5)
        for r in out:
            if r.fold == f:
                assert r.p == pytest.approx(1 / (1 + np.exp(-np.dot(data[r.k][0], w[:3]) - w[3])), abs=1e-8) and r.y == data[r.k][1]


def test_auc_equals_all_pairs(table):
    pick = random.Random(3)
    rows = [(pick.choice("ab"), pick.choice([0.0, 0.5, 1.0, round(pick.random(), 3)]), pick.randrange(2)) for _ in range(200)] + [("c", 0.5, 1)]
    got = {r.g: r.auc for r in classifier.auc(table("g string, p double, y int", rows), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([p for h, p, y in rows if h == g and y == z] for z in (1, 0))
        assert got[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]), abs=1e-12)
    assert got["c"] is None


def test_doubt_empty_and_bounds(table):
    assert classifier.out_of_fold(table(ROWS, []), "k", "x", "y").collect() == []
    scored = table("k int, fold int, y int, p double", [(1, 0, 1, 0.1), (2, 0, 1, 0.9), (3, 0, 0, 0.8)])
    assert {(r.k, round(r.doubt, 6)) for r in classifier.doubtful(scored, 0.7).collect()} == {(1, 0.9), (3, 0.8)}
    with pytest.raises(ValueError):
        classifier.fit_folds(table("fold int, x array<double>, y int", [(0, [1.0], 1), (1, [1.0, 2.0], 0)]), 2)
