"""Ridge from merged moments against fits of each fold's own rows, on features of any scale, window and range."""

import numpy as np
import pytest

from foldspark.operators import learners
from foldspark.operators.folds import WalkForwardConfig, boundaries
from foldspark.operators.learners import predict_ridge, ridge
from foldspark.operators.moments import Moments, windows


def table(spark, x, y, series="s"):
    rows = [(series, i, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "series_id string, ts long, row_idx long, " + ", ".join(f"x{k} double" for k in range(x.shape[1])) + ", target_next_return double")


def fitted(x, y, config):
    out = {}
    for f in boundaries(len(x), config):
        new = ridge(3.0)(x[f.train_start : f.train_end], y[f.train_start : f.train_end], x[f.test_start : f.test_end])
        out |= {(f.fold, i): v for i, v in zip(range(f.test_start, f.test_end), new)}
    return out


def test_merging_is_fitting_together():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * [1, 1e-3, 1e5, 0] + [1e8, 0, -1e9, 0.1]
    for cuts in ([7], [1, 2, 30], [20, 40]):
        merged = None
        for part in np.split(x, cuts):
            merged = Moments.of(part) if merged is None else merged + Moments.of(part)
        alone = Moments.of(x)
        assert merged.n == 60
        assert np.allclose(merged.origin + merged.mean, x.mean(0), rtol=1e-15)
        assert np.allclose(merged.comoment, alone.comoment, rtol=1e-9, atol=1e-7)
        assert not merged.comoment[3].any()  # a column of equal values has no spread at all
        assert np.array_equal(Moments.unpack(merged.pack(), 4).pack(), merged.pack())


def test_windows_merge_what_lives():
    rng = np.random.default_rng(1)
    begins = np.sort(rng.integers(0, 40, 60))
    ends = np.maximum.accumulate(begins + rng.integers(0, 9, 60))
    states = [(int(a), int(b), Moments.of(np.array([[float(k), 1.0]]))) for k, (a, b) in enumerate(zip(begins, ends))]
    for steps in (range(50), range(17, 30)):
        for step, merged in windows(iter(states), steps):
            alive = [k for k, (a, b, _) in enumerate(states) if a <= step <= b]
            assert (merged.n if merged else 0) == len(alive)
            if alive:
                assert (merged.origin + merged.mean)[0] == pytest.approx(np.mean(alive))


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6, 1e8])
def test_offsets_cost_no_digits(spark, offset):
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=120) + offset, rng.normal(size=120) * 1e-4, np.full(120, 0.1)]
    y = 0.3 * (x[:, 0] - offset) + rng.normal(size=120)
    config = WalkForwardConfig(40, 7, 1)
    got = {(r["fold"], r["row_idx"]): r["prediction"] for r in predict_ridge(table(spark, x, y), config).collect()}
    assert got == pytest.approx(fitted(x, y, config), rel=0, abs=1e-8)


@pytest.mark.parametrize("config", [WalkForwardConfig(30, 4, 0, None, 50), WalkForwardConfig(30, 1, 2, None, 33), WalkForwardConfig(30, 3, 0, 5), WalkForwardConfig(30, 2)])
def test_rolling_windows_forget(spark, monkeypatch, config):
    """Rows of size 1e8 leave no trace once they are out of the window, over borders of ranges of folds too."""
    monkeypatch.setattr(learners, "FOLD_RANGE", 6)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    x[:40] *= 1e8 if config.max_train_size else 1
    y = x[:, 0] / (1 + np.abs(x[:, 0])) + rng.normal(size=150)
    m = table(spark, x, y).unionByName(table(spark, x[:70] + 5, y[:70], "t"))
    got = {(r["series_id"], r["fold"], r["row_idx"]): r["prediction"] for r in predict_ridge(m, config).collect()}
    want = {("s", *k): v for k, v in fitted(x, y, config).items()} | {("t", *k): v for k, v in fitted(x[:70] + 5, y[:70], config).items()}
    assert got == pytest.approx(want, rel=1e-8, abs=1e-8)
