"""The flows that users call, on a small series of our own: what they write, what they say, and what they turn down."""

import json
import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import foldspark
from foldspark.cli import main
from foldspark.http import respond
from foldspark.operators import backtest
from foldspark.operators.folds import WalkForwardConfig
from foldspark.plans import experiment

DAYS = 330


@pytest.fixture(scope="module")
def wave(tmp_path_factory):
    """A file of three swings around a slow rise, with columns of other names than the defaults."""
    lines = ["day,price,traded"]
    for i in range(DAYS):
        price = 40 + i / 20 + 3 * math.sin(i / 9) + math.cos(i * i)
        lines.append(f"{date(2000, 1, 1) + timedelta(days=i)},{price!r},{500 + (i * 37) % 101}")
    path = tmp_path_factory.mktemp("files") / "wave.csv"
    path.write_text("\n".join(lines) + "\n")
    return path


@pytest.fixture(autouse=True)
def brief_fits(monkeypatch):
    """Few rounds: the flows are tested here, not the fit."""
    made = backtest.gradient_boosting
    monkeypatch.setattr(backtest, "gradient_boosting", lambda: made(rounds=4))


COLUMNS = ["--timestamp-column", "day", "--close-column", "price", "--volume-column", "traded"]


def ran(spark, folder, capsys, *argv):
    """Exit status, what was printed, and the documents in the folder."""
    status = main([*map(str, argv), "--output", str(folder)], spark)
    return status, json.loads(capsys.readouterr().out), {p.name: p.read_text() for p in folder.iterdir()}


def test_report_of_a_file(spark, wave, tmp_path, capsys):
    status, said, files = ran(spark, tmp_path / "new", capsys, "--csv", wave, *COLUMNS, "--cost-bps", 12.5)
    assert status == 0 and files.keys() == {"forecast_results.json", "forecast_report.html"}
    made = json.loads(files["forecast_results.json"])
    tested = DAYS - 62 - 250
    assert (made["observations"], made["cost_bps"], len(made["predictions"])) == (tested, 12.5, tested)
    assert said == {k: made[k] for k in ("observations", "models", "dataset")} | {"output": str(tmp_path / "new")}
    # The records are in order of time and give the metrics.
    stamps = [r["timestamp"] for r in made["predictions"]]
    assert all(a < b for a, b in zip(stamps, stamps[1:]))
    for model, m in made["models"].items():
        errors = [abs(r["actual"] - r[model]) for r in made["predictions"]]
        assert m["mae"] == pytest.approx(sum(errors) / tested)
    about = made["dataset"]
    assert (about["source_name"], about["raw_observations"], about["has_volume"], about["start"]) == ("wave.csv", DAYS, True, "2000-01-01T00:00:00Z")
    assert "Historical data" in files["forecast_report.html"] and all(m in files["forecast_report.html"] for m in made["models"])


def test_evidence_of_a_file(spark, wave, tmp_path, capsys):
    arguments = ("--csv", wave, *COLUMNS[:4], "--no-volume", "--evidence", "--seed", 3)
    status, said, files = ran(spark, tmp_path, capsys, *arguments)
    evidence, manifest = (json.loads(files[f]) for f in ("forecast_evidence.json", "candidate_manifest.json"))
    assert status == 0 and said == {"evidence": str(tmp_path), "decision": evidence["promotion_decision"]}
    assert evidence["dataset"]["has_volume"] is False and evidence["dataset"]["supervised_observations"] == DAYS - 62
    v = evidence["validation"]
    assert v["fold_count"] == len(v["folds"]) == 1 and v["out_of_sample_observations"] == sum(f["test_size"] for f in v["folds"])
    assert all(f["train_end"] + v["gap"] == f["test_start"] for f in v["folds"])
    assert evidence["aggregate_metrics"].keys() == backtest.default_models().keys()
    u = evidence["uncertainty"]
    assert u["calibration_size"] + u["evaluation_size"] == v["out_of_sample_observations"] and 0 <= u["coverage"] <= 1
    chosen = manifest["payload"]["model"]
    assert manifest["payload"] == {"model": chosen, "dataset": evidence["dataset"], "validation": v, "metrics": evidence["aggregate_metrics"][chosen], "decision": evidence["promotion_decision"]}
    # Another run of the same file gives the same bytes.
    assert ran(spark, tmp_path / "again", capsys, *arguments)[2] == files


#: Arguments that can't be used, each for one reason.
UNUSABLE = {
    "too few rows asked for": ["--rows", "12"],
    "a cost below nothing": ["--cost-bps", "-0.5"],
    "a cost without end": ["--cost-bps", "inf"],
    "two sources": ["--rows", "500", "--csv", "wave"],
    "a volume that is not wanted": ["--no-volume", "--volume-column", "traded"],
    "no such file": ["--csv", "nowhere.csv"],
    "no such column": ["--csv", "wave"],
    "a file too short": ["--csv", "short", *COLUMNS],
    "a file out of order": ["--csv", "turned", *COLUMNS],
}


@pytest.mark.parametrize("why", UNUSABLE)
def test_unusable_arguments(spark, wave, tmp_path, why):
    head, *lines = wave.read_text().splitlines()
    files = {"wave": [head, *lines], "short": [head, *lines[:200]], "turned": [head, *lines[::-1]]}
    for name, content in files.items():
        (tmp_path / name).write_text("\n".join(content) + "\n")
    argv = [str(tmp_path / a) if a in files else a for a in UNUSABLE[why]]
    with pytest.raises(SystemExit) as end:
        main(argv, spark)
    assert end.value.code == 2


def test_made_up_prices_are_called_so(spark):
    rows = 330
    payload = experiment.evidence(experiment.synthetic_market(spark, rows, 2), experiment.synthetic_dataset(rows, 2), 2, config=WalkForwardConfig(200, 34))
    assert payload["dataset"] == {"kind": experiment.KIND, "seed": 2, "raw_observations": rows, "supervised_observations": rows - 62}
    assert payload["claims"][-1] == experiment.SCOPE[True]
    assert payload["validation"]["fold_count"] == 2


def made_predictions(spark):
    """Two models on seven rows of a falling series."""
    rows = [("s", i, i, m, -i / 10, (-1) ** i * k / 5) for i in range(7) for k, m in enumerate(("naive_zero", "gradient_boosting"))]
    return spark.createDataFrame(rows, "series_id string, ts long, row_idx long, model string, actual double, prediction double")


#: Prediction tables that can't be evaluated: how each is made, and a word of what is said.
WRONG = {
    "an actual beyond numbers": (lambda t: t.withColumn("actual", F.when(F.col("row_idx") == 3, float("-inf")).otherwise(F.col("actual"))), "finite"),
    "a prediction left out": (lambda t: t.withColumn("prediction", F.when(F.col("row_idx") != 6, F.col("prediction"))), "finite"),
    "only one model": (lambda t: t.filter("model = 'naive_zero'"), "missing"),
    "words for numbers": (lambda t: t.withColumn("actual", F.col("actual").cast("string")), "numeric"),
    "a row tested twice": (lambda t: t.unionByName(t.filter("row_idx = 0")), "unique"),
    "no rows": (lambda t: t.limit(0), "empty"),
    "no model column": (lambda t: t.drop("model"), "columns"),
}


@pytest.mark.parametrize("what", WRONG)
def test_wrong_predictions(spark, what):
    make, word = WRONG[what]
    with pytest.raises(ValueError, match=word):
        foldspark.ForecastExperiment(2, 1).evaluate(make(made_predictions(spark)))


def test_evaluation(spark):
    e = foldspark.ForecastExperiment(2, 1)
    made = e.evaluate(made_predictions(spark).withColumn("fold", F.lit(1)), 0.0, records=True)
    assert made["observations"] == 7 and list(made["models"]) == ["naive_zero", "gradient_boosting"]
    assert made["models"]["naive_zero"]["mae"] == pytest.approx(0.3) and made["models"]["naive_zero"]["net_cumulative_return"] == 0
    assert made["predictions"][4] == {"timestamp": "4", "actual": -0.4, "naive_zero": 0.0, "gradient_boosting": 0.2}
    assert made["gradient_boosting_vs_naive_mae_bootstrap"]["samples"] == 3000
    assert "predictions" not in e.evaluate(made_predictions(spark))
    for cost in (float("nan"), -1e-9):
        with pytest.raises(ValueError, match="cost_bps"):
            e.evaluate(made_predictions(spark), cost)


def test_older_flow(spark, wave):
    m = foldspark.load_market_csv(spark, str(wave), timestamp_column="day", close_column="price", volume_column=None)
    got = experiment.simple_experiment(m.observations, WalkForwardConfig(200, 40), rounds=2).collect()
    assert [(r["model"], r["directional_accuracy"] is not None) for r in got] == [("gradient_boosting", True)]


def test_http(spark):
    assert respond(spark, "/health") == (200, {"status": "ok"})
    turned_down = [("rows", 5), ("rows", 9999), ("cost_bps", -3), ("cost_bps", 5000), ("seed", "one")]
    assert {respond(spark, f"/demo?{k}={v}")[0] for k, v in turned_down} == {422}
    assert respond(spark, "/elsewhere")[0] == 404


def test_public_names(spark):
    for name in foldspark.__all__:
        assert getattr(foldspark, name) is not None
    splitter = foldspark.WalkForwardSplitter(WalkForwardConfig(10, 4, 1))
    m = spark.range(30).select(F.lit("s").alias("series_id"), F.col("id").alias("row_idx"))
    assert [r["test_start"] for r in splitter.table(m).orderBy("fold").collect()] == [b.test_start for b in splitter.split(30)] == [11, 15, 19, 23, 27]
