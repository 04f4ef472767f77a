"""Known values and rejections of the analytics engine on tiny frames."""

import json
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from foldspark.functions.metrics import BusinessCost, evaluate_interval, evaluate_pair, mae, mase, pinball, rmse, smape
from foldspark.operators.backtest import BacktestRunner, ModelSpec, constant, historical_mean, seasonal_naive
from foldspark.operators.bootstrap import block_sums, default_block, loss_difference, paired_bootstrap, panel_bootstrap, random_starts, sampling_plan
from foldspark.operators.conformal import SplitConformalCalibrator, require_intervals
from foldspark.operators.features import align_volume, assert_no_leakage, checked_matrix
from foldspark.operators.folds import WalkForwardConfig, boundaries, fold_table, isolation_violations, test_rows as rows_tested, train_rows
from foldspark.operators.baselines import train_statistics
from foldspark.operators.learners import boosting, predict_learned, predict_ridge, ridge
from foldspark.operators.promotion import PromotionPolicy
from foldspark.plans import catalogue
from foldspark.plans.artifacts import render_report, write_manifest
from foldspark.sources.market import read_market_csv
from foldspark.sources.synthetic import synthetic_market


def pairs(spark, actual, predicted):
    return spark.createDataFrame([(float(a), float(p)) for a, p in zip(actual, predicted)], "actual double, prediction double")


def prices(spark, values, volume=None):
    rows = [("s", i, float(v), float(volume[i]) if volume else 1.0 + i % 7) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts long, close double, volume double")


def matrix(spark, n=40):
    return spark.createDataFrame([("s", i, i, float(i), math.sin(i / 4)) for i in range(n)], "series_id string, ts long, row_idx long, feature double, target_next_return double")


def test_metrics(spark):
    df = pairs(spark, [0, 1, 2], [0, 2, 1])
    a, b = evaluate_pair(df, mae(), rmse())
    assert (a, b) == pytest.approx((2 / 3, math.sqrt(2 / 3)))
    assert evaluate_pair(pairs(spark, [0, 1], [0, 1]), smape())[0] == 0
    assert evaluate_pair(pairs(spark, [2], [1]), pinball(0.9), pinball(0.1)) == pytest.approx((0.9, 0.1))
    iv = spark.createDataFrame([(0.0, -1.0, 1.0), (2.0, 0.0, 3.0)], "actual double, lower double, upper double")
    assert evaluate_interval(iv) == {"coverage": 1.0, "mean_width": 2.5}
    under, over = (pairs(spark, [1], [0]).agg(*BusinessCost(3, 1).aggregates()).first()[0], pairs(spark, [0], [1]).agg(*BusinessCost(3, 1).aggregates()).first()[0])
    assert under / over == 3
    assert pairs(spark, [1], [0]).agg(*BusinessCost().aggregates()).first()["action_rate"] == 0
    train = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 3, 2])], "i long, target double")
    assert mase(df, train, "i") == pytest.approx((2 / 3) / 1.5)
    seasonal = spark.createDataFrame([(-i, float(i % 4 + i)) for i in range(30)], "i long, target double")
    assert mase(df, seasonal, "i", 4) == pytest.approx((2 / 3) / 4)
    for rows, season, message in ((train, 3, "exceed"), (train, 0, "at least 1"), (train.withColumn("target", F.lit(1.0)), 1, "constant")):
        with pytest.raises(ValueError, match=message):
            mase(df, rows, "i", season)
    for bad in (pairs(spark, [], []), pairs(spark, [float("nan")], [0])):
        with pytest.raises(ValueError, match="finite and non-empty"):
            evaluate_pair(bad, mae())
    with pytest.raises(ValueError, match="quantile"):
        pinball(1.0)
    with pytest.raises(ValueError, match="negative"):
        BusinessCost(-1)
    with pytest.raises(ValueError, match="lower interval"):
        evaluate_interval(iv.withColumn("lower", F.lit(9.0)))


def test_folds(spark):
    first = boundaries(25, WalkForwardConfig(10, 4, 2))[0]
    assert (first.train_start, first.train_end, first.test_start, first.test_end) == (0, 10, 12, 16)
    for config in (WalkForwardConfig(10, 4, 2), WalkForwardConfig(10, 4, 1, 6), WalkForwardConfig(10, 4, 0, None, 12)):
        made = fold_table(spark.createDataFrame([("s", 40)], "series_id string, n long"), config)
        expected = {(b.fold, b.train_start, b.train_end, b.test_start, b.test_end) for b in boundaries(40, config)}
        assert {(r["fold"], r["train_start"], r["train_end"], r["test_start"], r["test_end"]) for r in made.collect()} == expected
        assert tuple(isolation_violations(made, config).first()) == (0, 0, 0)
        m = matrix(spark)
        assert {(r["fold"], r["row_idx"]) for r in rows_tested(m, config).collect()} == {(f, i) for f, _, _, a, b in expected for i in range(a, b)}
        assert {(r["fold"], r["row_idx"]) for r in train_rows(m, config).collect()} == {(f, i) for f, a, b, _, _ in expected for i in range(a, b)}
    with pytest.raises(ValueError, match="not enough"):
        boundaries(12, WalkForwardConfig(10, 4, 2))
    for bad in ({"min_train_size": 1}, {"test_size": 0}, {"gap": -1}, {"step_size": 0}, {"max_train_size": 5}):
        with pytest.raises(ValueError):
            WalkForwardConfig(**bad)


def test_backtest(spark):
    models = {"zero": constant(), "mean": historical_mean(), "season": seasonal_naive(3)}
    result = BacktestRunner(WalkForwardConfig(15, 5, 1), models).run(matrix(spark))
    folds = result.folds.orderBy("fold").collect()
    assert len(folds) == 5 and folds[0]["train_end"] == 15
    y = [math.sin(i / 4) for i in range(40)]
    for r in result.predictions.collect():
        f = folds[r["fold"]]
        history = y[f["train_start"] : f["train_end"]]
        expected = {"zero": 0.0, "mean": np.mean(history), "season": history[-3 + (r["row_idx"] - f["test_start"]) % 3]}[r["model"]]
        assert r["prediction"] == pytest.approx(expected) and r["actual"] == pytest.approx(y[r["row_idx"]])
    with pytest.raises(ValueError, match="overlapping"):
        BacktestRunner(WalkForwardConfig(15, 5, 0, 2), models).run(matrix(spark))
    with pytest.raises(ValueError, match="not enough observations"):
        BacktestRunner(WalkForwardConfig(15, 5, 1), models).run(matrix(spark, 12))
    with pytest.raises(ValueError, match="exceed seasonality"):
        train_statistics(matrix(spark), WalkForwardConfig(15, 5), seasonality=15)
    # Ridge from running sums, and any learner by runs of folds, are fits of each fold's own rows.
    m = matrix(spark).withColumn("other", F.cos(F.col("row_idx") * 1.7)).withColumn("same", F.lit(2.0))
    for config in (WalkForwardConfig(15, 1, 1), WalkForwardConfig(12, 4, 0, 5, 17)):
        x = np.array([[i, math.cos(i * 1.7), 2.0] for i in range(40)], float)
        expected = {}
        for f in boundaries(40, config):
            fit = ridge(3.0)(x[f.train_start : f.train_end], np.array(y[f.train_start : f.train_end]), x[f.test_start : f.test_end])
            expected |= {(f.fold, i): v for i, v in zip(range(f.test_start, f.test_end), fit)}
        for made in (predict_ridge(m, config), predict_learned(m, config, "ridge", ridge(3.0))):
            assert {(r["fold"], r["row_idx"]): r["prediction"] for r in made.collect()} == pytest.approx(expected, rel=1e-6, abs=1e-8)
    with pytest.raises(ValueError, match="at least one model"):
        BacktestRunner(WalkForwardConfig(15, 5), {})
    with pytest.raises(ValueError, match="reserved"):
        BacktestRunner(WalkForwardConfig(15, 5), {"fold": constant()})


def test_quarantine(spark):
    """A short and a constant series, and one with an invalid prediction, don't end the run of the others."""
    y = {"good": [math.sin(i / 4) for i in range(40)], "short": [0.1, 0.2, 0.4], "edge": [math.cos(i) for i in range(16)], "same": [0.25] * 40, "late": [0.25] * 17 + [math.sin(i) for i in range(23)]}
    m = spark.createDataFrame([(s, i, i, float(i), float(v)) for s, ys in y.items() for i, v in enumerate(ys)], "series_id string, ts long, row_idx long, feature double, target_next_return double")
    config, models = WalkForwardConfig(15, 5, 1), {"zero": constant(), "mean": historical_mean()}
    result = BacktestRunner(config, models).run(m)
    rules = {r["series_id"]: (r["rule"], r["reason"]) for r in result.quarantine.collect()}
    assert {s: rule for s, (rule, _) in rules.items()} == {"short": "too_short", "edge": "too_short", "same": "constant_history", "late": "constant_history"}
    assert rules["edge"][1] == "not enough observations: 16, and the first fold tests row 16"
    for df in (result.predictions, result.folds, result.fold_metrics):
        assert {r["series_id"] for r in df.select("series_id").distinct().collect()} == {"good"}
    alone = BacktestRunner(config, models).run(m.filter("series_id = 'good'"))
    assert sorted(map(tuple, result.fold_metrics.collect())) == sorted(map(tuple, alone.fold_metrics.collect()))
    loose = BacktestRunner(config, models, strict=False).run(m)
    assert {r["series_id"] for r in loose.quarantine.collect()} == {"short", "edge"}
    assert loose.fold_metrics.filter("series_id = 'same'").agg(F.count("*"), F.count("mase")).first() == (5 * 2, 0)
    broken = models | {"broken": ModelSpec(column=lambda config: F.when((F.col("fold") == 1) & (F.col("series_id") == "late"), float("inf")).otherwise(F.col("train_mean")))}
    rules = {r["series_id"]: r["reason"] for r in BacktestRunner(config, broken, strict=False).run(m).quarantine.collect()}
    assert rules["late"] == "invalid prediction vector: broken"
    for bad, message in (("short", "not enough observations"), ("same", "constant training history")):
        with pytest.raises(ValueError, match=message):
            BacktestRunner(config, models).run(m.filter(F.col("series_id") == bad))


def test_features(spark):
    base = [100 + i / 4 + math.sin(i) for i in range(90)]
    made = checked_matrix(prices(spark, base)).orderBy("row_idx").collect()
    assert len(made) == 90 - 62
    changed = list(base)
    changed[80] *= 3
    again = {r["ts"]: r for r in checked_matrix(prices(spark, changed)).collect()}
    for r in made:  # what comes later changes no feature
        if r["ts"] <= 80:
            assert all(r[c] == again[r["ts"]][c] for c in r.asDict() if c != "target_next_return")
    with pytest.raises(ValueError, match="at least 63"):
        checked_matrix(prices(spark, base[:20]))
    for values, message in (([*base[:70], 0.0], "strictly positive"), ([*base[:70], float("inf")], "strictly positive")):
        with pytest.raises(ValueError, match=message):
            checked_matrix(prices(spark, values))
    close = prices(spark, base[:3]).drop("volume")
    with pytest.raises(ValueError, match="every close timestamp"):
        align_volume(close, prices(spark, base[:2]).drop("close"))
    m = matrix(spark)
    for bad, message in ((m.withColumn("next_close", F.lit(1.0)), "forbidden"), (m.drop("target_next_return"), "required"), (m.drop("feature"), "at least one feature"), (m.withColumn("feature", F.lit("x")), "numeric"), (m.withColumn("feature", F.lit(float("nan"))), "finite")):
        with pytest.raises(ValueError, match=message):
            assert_no_leakage(bad)


def test_conformal_bootstrap_promotion(spark):
    c = SplitConformalCalibrator(0.8).fit(pairs(spark, [0, 1, 2, 3], [0, 0, 0, 0]))
    assert c.radius == 3
    r = c.predict(pairs(spark, [0], [10])).first()
    assert (r["lower"], r["upper"]) == (7, 13)
    with pytest.raises(RuntimeError, match="fitted"):
        SplitConformalCalibrator().predict(pairs(spark, [0], [0]))
    with pytest.raises(ValueError, match="at least two"):
        SplitConformalCalibrator().fit(pairs(spark, [0], [0]))
    actual, a, b = [0, 1, -1, 2, -2, 1], [0, 0.5, -0.5, 1, -1, 0.5], [0.0] * 6
    rows = spark.createDataFrame([("s", i, m, float(x), float(p)) for m, ps in (("a", a), ("b", b)) for i, (x, p) in enumerate(zip(actual, ps))], "series_id string, row_idx long, model string, actual double, prediction double")
    made = paired_bootstrap(rows, "a", "b", samples=200, block_size=3, seed=9)
    d = np.array([abs(x - p) - abs(x - q) for x, p, q in zip(actual, a, b)])
    plan = sampling_plan(loss_difference(rows, "a", "b"), 3)
    starts = np.array([r["start"] for r in random_starts(plan, 200, 9).orderBy("sample", "block_no").collect()]).reshape(200, 2)
    assert set(starts.ravel()) == set(range(6))
    means = d[(starts[:, :, None] + np.arange(3)) % 6].reshape(200, -1)[:, :6].mean(1)
    assert (made["observed_mae_difference"], made["bootstrap_p05"], made["bootstrap_p95"]) == pytest.approx((d.mean(), np.quantile(means, 0.05), np.quantile(means, 0.95)))
    with pytest.raises(ValueError, match="block_size"):
        paired_bootstrap(rows, "a", "b", block_size=7)
    for bad in (rows.withColumn("prediction", F.lit(float("inf"))), rows.filter("model = 'a'"), rows.filter("false")):
        with pytest.raises(ValueError, match="paired vectors"):
            paired_bootstrap(bad, "a", "b")
    iv = spark.createDataFrame([(1.0, 0.0, 2.0, 0.9)], "point double, lower double, upper double, coverage double")
    require_intervals(iv)
    for bad in ({"lower": 1.5}, {"upper": float("nan")}, {"coverage": 1.0}, {"upper": 0.5}):
        with pytest.raises(ValueError, match="interval"):
            require_intervals(iv.withColumns({k: F.lit(v) for k, v in bad.items()}))
    pooled = lambda x, y: spark.createDataFrame([("c", float(x[0]), float(x[1])), ("b", float(y[0]), float(y[1]))], "model string, mae double, mean_business_cost double")
    folds = lambda x, y: spark.createDataFrame([(k, m, v) for k in (0, 1) for m, v in (("c", x), ("b", y))], "fold long, model string, mae double")
    got = PromotionPolicy().decide("c", "b", pooled((0.8, 1.2), (1.0, 1.0)), folds(0.8, 1.0))
    assert got["status"] == "rejected" and got["reasons"] == ["business_cost_regression"]
    got = PromotionPolicy().decide("c", "b", pooled((1.0, 1.0), (0.0, 1.0)), folds(1.0, 0.0))
    assert got["metrics"]["relative_mae_improvement"] == -1 and not got["promoted"]
    assert PromotionPolicy().decide("c", "b", pooled((0.8, 0.9), (1.0, 1.0)), folds(0.8, 1.0))["promoted"]
    with pytest.raises(ValueError, match="different"):
        PromotionPolicy().decide("c", "c", pooled((1, 1), (1, 1)), folds(1.0, 1.0))
    with pytest.raises(ValueError, match="missing models"):
        PromotionPolicy().decide("x", "b", pooled((1, 1), (1, 1)), folds(1.0, 1.0))


def test_panel_bootstrap(spark):
    """Each series has its own length and block, and what it has by itself."""
    rng = np.random.default_rng(3)
    sizes = {"a": 1, "b": 8, "c": 27, "d": 100}
    rows = [(s, 3 * i + 7, m, float(x), float(x + e)) for s, n in sizes.items() for i, x in enumerate(rng.normal(size=n)) for m, e in zip("pq", rng.normal(size=2))]
    df = spark.createDataFrame([*rows, ("bad", 0, "p", 1.0, float("inf")), ("bad", 0, "q", 1.0, 1.0)], "series_id string, row_idx long, model string, actual double, prediction double")
    diff = loss_difference(df.filter("series_id <> 'bad'"), "p", "q", 10).cache()
    plan = {r["series_id"]: (r["n"], r["block"], r["blocks"]) for r in sampling_plan(diff).collect()}
    assert plan == {s: (n, default_block(n), -(-n // default_block(n))) for s, n in sizes.items()}
    values = {s: [r["d"] for r in diff.filter(F.col("series_id") == s).orderBy("i").collect()] for s in sizes}
    for r in block_sums(diff, sampling_plan(diff), 10).collect():
        n, block, blocks = plan[r["series_id"]]
        around = values[r["series_id"]] * 2
        a = r["start"]
        assert (r["full"], r["tail"]) == pytest.approx((sum(around[a : a + block]), sum(around[a : a + n - (blocks - 1) * block])))
    made = {r["series_id"]: r for r in panel_bootstrap(df, "p", "q", samples=50).collect()}
    assert made.keys() == sizes.keys()
    for s in sizes:
        alone = paired_bootstrap(df.filter(F.col("series_id") == s), "p", "q", samples=50)
        assert [made[s][k] for k in ("block_size", "observed_mae_difference", "bootstrap_p05", "bootstrap_p95")] == pytest.approx([alone[k] for k in ("block_size", "observed_mae_difference", "bootstrap_p05", "bootstrap_p95")])


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = np.sign(x[:, 0]) + 0.1 * rng.normal(size=300)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(300)]
    w = np.linalg.solve(z.T @ z + np.diag([3.0] * 4 + [0]), z.T @ y)
    assert np.allclose(ridge(3.0)(x, y, x), z @ w)
    fit = boosting()(x, y, x)
    assert np.array_equal(fit, boosting()(x, y, x))
    assert np.mean((fit - y) ** 2) < 0.1 < np.mean((y - y.mean()) ** 2)


def test_csv(spark, tmp_path):
    head, rows = "timestamp,close,volume", [f"2024-01-0{d},{100 + d},{1000 + d}" for d in range(1, 5)]

    def write(name, lines, first=head):
        path = tmp_path / name
        path.write_text("\n".join([first, *lines]) + "\n")
        return str(path)

    a, b = read_market_csv(spark, write("a.csv", rows)), read_market_csv(spark, write("b.csv", rows))
    assert a.sha256 == b.sha256 and a.source_name == "a.csv" and a.metadata()["raw_observations"] == 4
    assert a.sha256 != read_market_csv(spark, write("c.csv", [*rows[:3], "2024-01-04,105,1004"])).sha256
    assert not read_market_csv(spark, write("d.csv", [r.rsplit(",", 1)[0] for r in rows], "date,price"), timestamp_column="date", close_column="price", volume_column=None).has_volume
    broken = {"increasing": rows[::-1], "unique": [*rows, rows[-1]], "invalid timestamps": ["bad-date,1,1", *rows], "strictly positive": [rows[0], "2024-01-02,0,1"], "negative": [rows[0], "2024-01-02,1,-1"], "finite numeric": [rows[0], "2024-01-02,x,1"], "empty": []}
    for message, lines in broken.items():
        with pytest.raises(ValueError, match=message):
            read_market_csv(spark, write("x.csv", lines))
    with pytest.raises(ValueError, match="does not exist"):
        read_market_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="missing columns"):
        read_market_csv(spark, write("a.csv", rows), close_column="price")
    with pytest.raises(ValueError, match="distinct"):
        read_market_csv(spark, write("a.csv", rows), close_column="timestamp")


def test_synthetic_and_artifacts(spark, tmp_path):
    rows = synthetic_market(spark, 30, 5).orderBy("ts").collect()
    rng = np.random.default_rng(5)
    rng.lognormal(14.8, 0.30, 30)
    r = 0.0
    close = [100.0]
    for i in range(1, 30):
        phi, sigma = (0.12, 0.010) if i < 30 * 0.35 else (-0.08, 0.016) if i < 30 * 0.70 else (0.05, 0.008)
        r = phi * r + 0.0015 * math.sin(i / 17) + rng.normal(0, sigma)
        close.append(close[-1] * math.exp(r))
    assert [x["close"] for x in rows] == pytest.approx(close)
    with pytest.raises(TypeError):
        synthetic_market(spark, True)
    with pytest.raises(ValueError, match="at least 2"):
        synthetic_market(spark, 1)
    a = write_manifest(tmp_path / "m.json", {"b": 1, "a": 2})
    assert a["sha256"] == write_manifest(tmp_path / "m.json", {"a": 2, "b": 1})["sha256"]
    assert json.loads((tmp_path / "m.json").read_text())["payload"] == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        write_manifest(tmp_path / "n.json", {"a": float("nan")})
    metrics = {"mae": 1, "rmse": 1, "directional_accuracy": 0.5, "strategy_sharpe": 0, "net_cumulative_return": 0}
    page = render_report({"models": {"<b>": metrics}, "dataset": {"kind": "market_csv"}}, tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in page and "Historical" in page


@pytest.mark.parametrize("name, config", [("ridge_backtest", (250, 20, 0)), ("boosting_backtest", (250, 20, 0)), ("evidence_summary", (250, 25, 1))])
def test_learner_queries_use_the_folds_of_their_flow(spark, monkeypatch, name, config):
    class Seen(Exception):
        pass

    def predictions(matrix, config, models):
        raise Seen(config)

    monkeypatch.setattr(catalogue, "predictions", predictions)
    with pytest.raises(Seen) as seen:
        catalogue.QUERIES[name](spark, SMALL)
    assert seen.value.args == (WalkForwardConfig(*config),)
