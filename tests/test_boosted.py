"""Boosting by levels of Spark sums against the local learner, and both against plain trees grown row by row."""

import numpy as np
import pytest

from foldspark.operators import boosted
from foldspark.operators.boosted import boost_by_levels, fold_edges, predict_boosting
from foldspark.operators.folds import WalkForwardConfig, boundaries
from foldspark.operators.learners import boosting


def plain_boosting(x, y, new, rounds, depth, rate, l2, least):
    """Trees by trying each midpoint of each feature for each node's own rows."""

    def grow(rows, residual, level):
        g, h = residual[rows].sum(), len(rows)
        best, split = 1e-12, None
        if level < depth:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for edge in (values[1:] + values[:-1]) / 2:
                    left = rows[x[rows, f] <= edge]
                    if least <= len(left) <= h - least:
                        a = residual[left].sum()
                        gain = a * a / (len(left) + l2) + (g - a) ** 2 / (h - len(left) + l2) - g * g / (h + l2)
                        if gain > best * (1 + 1e-9):
                            best, split = gain, (f, edge)
        if split is None:
            return -rate * g / (h + l2)
        f, edge = split
        return f, edge, grow(rows[x[rows, f] <= edge], residual, level + 1), grow(rows[x[rows, f] > edge], residual, level + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            f, edge, left, right = tree
            tree = left if row[f] <= edge else right
        return tree

    fit, out = np.full(len(y), y.mean()), np.full(len(new), y.mean())
    for _ in range(rounds):
        tree = grow(np.arange(len(y)), fit - y, 0)
        fit += [value(tree, r) for r in x]
        out += [value(tree, r) for r in new]
    return out


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2) * [1, 100, 0.01]
    x[:, 2] = np.round(x[:, 2], 2)  # few values
    return x, np.sin(x[:, 0] * 2) + (x[:, 1] > 30) + rng.normal(size=n) / 10


def table(spark, sizes):
    rows = []
    for k, (s, n) in enumerate(sizes.items()):
        x, y = data(n, k)
        rows += [(s, i, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "series_id string, ts long, row_idx long, a double, `b c` double, d double, target_next_return double")


def test_local_learner_grows_plain_trees():
    x, y = data(120, 0)
    new = data(40, 9)[0]
    want = plain_boosting(x, y, new, 6, 3, 0.1, 0.5, 8)
    assert boosting(6, 3, 0.1, 0.5, 255, 8)(x, y, new) == pytest.approx(want)


@pytest.mark.parametrize("config", [WalkForwardConfig(60, 30, 1), WalkForwardConfig(60, 20, 0, 35, 70)])
def test_levels_grow_the_local_trees(spark, monkeypatch, config):
    monkeypatch.setattr(boosted, "CHUNK_ROWS", 25)
    sizes = {"s": 150, "t": 100, "short": 20}
    how = {"rounds": 3, "depth": 2, "rate": 0.3, "least": 6}
    want = {}
    for k, (s, n) in enumerate(list(sizes.items())[:2]):
        x, y = data(n, k)
        for f in boundaries(n, config):
            fit = boosting(**how)(x[f.train_start : f.train_end], y[f.train_start : f.train_end], x[f.test_start : f.test_end])
            want |= {(s, f.fold, i): v for i, v in zip(range(f.test_start, f.test_end), fit)}
    got = boost_by_levels(table(spark, sizes), config, **how).collect()
    assert {(r["series_id"], r["fold"], r["row_idx"]): r["prediction"] for r in got} == pytest.approx(want)


def test_long_series_go_by_levels(spark, monkeypatch):
    m, config = table(spark, {"long": 120, "brief": 90}), WalkForwardConfig(60, 30)
    how = {"rounds": 2, "depth": 1, "least": 5}
    local = sorted(map(tuple, predict_boosting(m, config, **how).collect()))
    by_levels = []
    monkeypatch.setattr(boosted, "boost_by_levels", lambda m, *a, **k: by_levels.extend(r[0] for r in m.select("series_id").distinct().collect()) or boost_by_levels(m, *a, **k))
    mixed = sorted(map(tuple, predict_boosting(m, config, local_rows=100, **how).collect()))
    assert by_levels == ["long"]
    assert [r[:6] for r in mixed] == [r[:6] for r in local]
    assert [r[6] for r in mixed] == pytest.approx([r[6] for r in local])


def test_edges(spark):
    rng = np.random.default_rng(0)
    rows = [("s", 0, float(v), float(i % 3)) for i, v in enumerate(rng.normal(size=5000))]
    (r,) = fold_edges(spark.createDataFrame(rows, "series_id string, fold long, x0 double, x1 double"), ["x0", "x1"], 16).collect()
    many, few = r["edges"]
    assert few == [0.5, 1.5]
    ranks = np.searchsorted(np.sort([v[2] for v in rows]), many) / 5000
    assert len(many) == 15 and np.abs(ranks - np.arange(1, 16) / 16).max() < 0.002
