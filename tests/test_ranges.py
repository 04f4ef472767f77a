"""Work by ranges of a series gives the rows that work on whole series gives, at the borders of ranges too."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import baselines, features
from foldspark.operators.baselines import changes, fold_states, train_statistics
from foldspark.operators.features import checked_matrix, supervised_matrix
from foldspark.operators.folds import WalkForwardConfig, boundaries
from foldspark.operators.ranges import numbered, with_halo
from foldspark.operators.strategy import strategy_metrics, strategy_path


@pytest.fixture(scope="module")
def observations(spark):
    rng = np.random.default_rng(0)
    rows = []
    for series, n in (("a", 300), ("b", 90), ("c", 20), ("d", 63)):
        close = 100 * np.exp(np.cumsum(rng.normal(size=n) / 50))
        volume = rng.integers(0, 5, n).astype(float)  # zeros make ratios that are left out
        rows += [(series, 1000 - 3 * i if series == "b" else i, float(c), float(v)) for i, (c, v) in enumerate(zip(close, volume))]
    rng.shuffle(rows)
    return spark.createDataFrame([(r[0], int(r[1]), float(r[2]), float(r[3])) for r in rows], "series_id string, ts long, close double, volume double").cache()


def test_numbers_follow_the_order(spark, observations):
    got = [r["number"] for r in numbered(observations, ["series_id", "ts"]).orderBy("series_id", "ts").collect()]
    assert got == list(range(observations.count()))
    assert numbered(observations.filter("false"), ["ts"]).collect() == []
    # A halo reaches over several ranges where ranges are short.
    df = spark.range(20).withColumnRenamed("id", "n")
    for size, before, after in ((4, 3, 1), (4, 9, 0), (1, 2, 2), (50, 5, 5)):
        made = with_halo(df, "n", before, after, size).collect()
        for k in range(-(-20 // size)):
            own = set(range(k * size, min(20, (k + 1) * size)))
            seen = {i for i in range(20) if any(o - before <= i <= o + after for o in own)} | own
            assert {r["n"] for r in made if r["range"] == k} >= seen
            assert {r["n"] for r in made if r["range"] == k and not r["halo"]} == own


@pytest.mark.parametrize("volume", [True, False])
@pytest.mark.parametrize("size", [5, 61, 64, 1000])
def test_features_by_ranges(observations, size, volume):
    df = observations if volume else observations.drop("volume")
    want = supervised_matrix(df)
    got = supervised_matrix(df, size)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_long_series_are_cut_by_themselves(observations, monkeypatch):
    seen = []
    monkeypatch.setattr(features, "RANGE_ROWS", 128)
    monkeypatch.setattr(features, "supervised_matrix", lambda df, size=None: seen.append(size) or supervised_matrix(df, size))
    assert checked_matrix(observations).count() == supervised_matrix(observations).count()
    checked_matrix(observations.filter("series_id = 'b'"))
    assert seen == [128, None]


def path(actual, predicted, cost):
    """Wealth and drawdown as a plain loop."""
    out, wealth, high, held = [], 1.0, -math.inf, 0.0
    for a, p in zip(actual, predicted):
        position = float(np.sign(p))
        net = position * a - abs(position - held) * cost / 1e4
        held, wealth = position, wealth * (1 + net)
        high = max(high, wealth)
        out.append((net, wealth, wealth / high - 1))
    return out


@pytest.mark.parametrize("size", [1, 7, 16, 1000])
def test_wealth_by_ranges(spark, size):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for series, n, scale in (("calm", 60, 0.02), ("wild", 41, 1.5)):  # the wild one loses more than all it has
        actual = rng.normal(size=n) * scale
        for model in ("m", "zero"):
            predicted = rng.normal(size=n) * (model == "m")
            # Numbers begin anywhere and have holes, as tested rows may.
            places = 250 + np.cumsum(rng.integers(1, 4, n))
            rows += [(series, int(i), model, float(a), float(p)) for i, a, p in zip(places, actual, predicted)]
            want |= {(series, model, int(i)): v for i, v in zip(places, path(actual, predicted, 5.0))}
    df = spark.createDataFrame(rows, "series_id string, row_idx long, model string, actual double, prediction double")
    got = strategy_path(df, 5.0, size)
    assert {"series_id", "row_idx", "model", "actual", "prediction", "position", "turnover", "gross", "net", "wealth", "drawdown"} == set(got.columns)
    found = {(r["series_id"], r["model"], r["row_idx"]): (r["net"], r["wealth"], r["drawdown"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, rel=1e-9, abs=1e-9)
    if size == 7:
        r = {(x["series_id"], x["model"]): x for x in strategy_metrics(df).collect()}["wild", "m"]
        assert r["max_drawdown"] == pytest.approx(min(v[2] for k, v in want.items() if k[:2] == ("wild", "m")))


@pytest.mark.parametrize("config, seasonality, season", [(WalkForwardConfig(15, 5, 1), 1, 3), (WalkForwardConfig(15, 4, 2, 6), 3, 9), (WalkForwardConfig(12, 1, 0), 2, 5), (WalkForwardConfig(12, 5, 0, None, 12), 1, 12), (WalkForwardConfig(12, 3, 1, 4, 23), 4, 2), (WalkForwardConfig(12, 2, 3, None, 17), 5, 11), (WalkForwardConfig(20, 30, 0, None, 21), 6, 20)])
def test_states_by_blocks(spark, monkeypatch, config, seasonality, season):
    monkeypatch.setattr(baselines, "RANGE_ROWS", 8)
    y = {s: np.random.default_rng(n).normal(size=n) for s, n in (("a", 80), ("b", 41))}
    m = spark.createDataFrame([(s, i, i, float(v)) for s, ys in y.items() for i, v in enumerate(ys)], "series_id string, ts long, row_idx long, y double")
    want = {}
    for s, ys in y.items():
        for f in boundaries(len(ys), config):
            t = ys[f.train_start : f.train_end]
            for i in range(f.test_start, f.test_end):
                want[s, f.fold, i] = [t.mean(), np.abs(t[seasonality:] - t[:-seasonality]).mean(), *t[-season:]]
    got = {(r["series_id"], r["fold"], r["row_idx"]): [r["train_mean"], r["mase_scale"], *r[f"recent_{season}"]] for r in fold_states(m, config, "y", seasonality, (season,)).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    each = {(r["series_id"], r["fold"]): r["mase_scale"] for r in train_statistics(m, config, "y", seasonality).collect()}
    assert each == pytest.approx({k[:2]: v[1] for k, v in want.items()})


def test_changes_cross_ranges(spark):
    rows = spark.range(50).select(F.lit("s").alias("series_id"), F.col("id").alias("row_idx"), (F.col("id") * F.col("id")).cast("double").alias("actual"))
    for size in (1, 4, 9, 100):
        got = {r["row_idx"]: r["change"] for r in changes(rows, 3, size).collect()}
        assert got == {i: None if i < 3 else float(i * i - (i - 3) ** 2) for i in range(50)}
