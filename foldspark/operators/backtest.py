"""The walk-forward backtest: predictions of many models in long form, and their metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import EPSILON, BusinessCost, mae, point_metrics, rmse, smape
from ..functions.scalar import is_finite
from ..scratch import Scratch
from .baselines import PREDICTION, fold_states, folds_of, seasonal, train_statistics
from .boosted import predict_boosting
from .features import TARGET, assert_no_leakage
from .folds import WalkForwardConfig
from .learners import Learner, predict_learned, predict_ridge


@dataclass(frozen=True)
class ModelSpec:
    """A model by backend.

    ``column``: a function of the config, an expression over a fold's state (see ``fold_states``) with ``season`` recent
    labels. ``plan``: a function (matrix, config, name, target) -> prediction rows. ``learner``: a function on numpy arrays.
    """

    column: Callable[[WalkForwardConfig], Column] | None = None
    season: int | None = None
    plan: Callable[..., DataFrame] | None = None
    learner: Learner | None = None

    def predict(self, matrix, config, name, target) -> DataFrame:
        """Rows of a model that is no column."""
        if self.learner:
            return predict_learned(matrix, config, name, self.learner, target)
        return self.plan(matrix, config, name, target)


def constant(value: float = 0.0) -> ModelSpec:
    return ModelSpec(lambda config: F.lit(float(value)))


def historical_mean() -> ModelSpec:
    return ModelSpec(lambda config: F.col("train_mean"))


def seasonal_naive(season: int = 5) -> ModelSpec:
    return ModelSpec(lambda config: seasonal(season, config), season)


def ridge_regression(alpha: float = 3.0) -> ModelSpec:
    return ModelSpec(plan=lambda matrix, config, name, target: predict_ridge(matrix, config, name, alpha, target))


def gradient_boosting(**how) -> ModelSpec:
    """Boosting with the settings of ``learners.boosting``, by levels where a series is too long for one task."""
    return ModelSpec(plan=lambda matrix, config, name, target: predict_boosting(matrix, config, name, target, **how))


def learned(learner: Learner) -> ModelSpec:
    return ModelSpec(learner=learner)


def default_models(seed: int = 42) -> dict[str, ModelSpec]:
    """The five default models by name. The boosting fit has no randomness, so the seed changes nothing."""
    return {
        "naive_zero": constant(),
        "historical_mean": historical_mean(),
        "seasonal_naive_5": seasonal_naive(5),
        "ridge": ridge_regression(3.0),
        "gradient_boosting": gradient_boosting(),
    }


def predictions(matrix: DataFrame, config: WalkForwardConfig, models: dict[str, ModelSpec], target: str = TARGET) -> DataFrame:
    """Rows of (series_id, ts, row_idx, fold, model, actual, prediction, mase_scale), one for each tested row and model.

    Models that are columns are unfolded from one pass over the tested rows; others are united with them, and for them
    the matrix is written first.
    """
    columns = {name: spec for name, spec in models.items() if spec.column}
    if len(columns) < len(models):  # they read the matrix several times
        matrix = Scratch(matrix.sparkSession, "matrix").write(matrix, "matrix")
    seasons = sorted({spec.season for spec in columns.values() if spec.season})
    parts = []
    if columns:
        each = [F.struct(F.lit(name).alias("model"), spec.column(config).cast("double").alias("prediction")) for name, spec in columns.items()]
        states = fold_states(matrix, config, target, seasons=seasons)
        parts.append(states.withColumn("p", F.explode(F.array(*each))).select("series_id", "ts", "row_idx", "fold", "p.model", "actual", "p.prediction", "mase_scale"))
    others = [spec.predict(matrix, config, name, target) for name, spec in models.items() if not spec.column]
    if others:
        scales = train_statistics(matrix, config, target).select("series_id", "fold", "mase_scale")
        parts.append(reduce(DataFrame.unionByName, others).join(scales, ["series_id", "fold"], "left").select(*PREDICTION, "mase_scale"))
    return reduce(DataFrame.unionByName, parts)


def wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each tested observation, a column for each model."""
    each = (F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in names)
    return rows.groupBy("series_id", "ts", "row_idx", "fold").agg(F.max("actual").alias("actual"), *each)


def repeated_tests(rows: DataFrame) -> DataFrame:
    """(series_id, row_idx, model, n) of rows tested more than once."""
    return rows.groupBy("series_id", "row_idx", "model").agg(F.count("*").alias("n")).filter("n > 1")


def fold_metrics(rows: DataFrame) -> DataFrame:
    """mae, rmse, smape and mase of each (series_id, fold, model) of prediction rows with their mase_scale.

    mase is null where its scale is (near) 0.
    """
    by = rows.groupBy("series_id", "fold", "model").agg(mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape"), F.max("mase_scale").alias("scale"))
    scale = F.when(F.col("scale") > EPSILON, F.col("scale"))
    return by.select("series_id", "fold", "model", "mae", "rmse", "smape", (F.col("mae") / scale).alias("mase"))


def pooled_metrics(rows: DataFrame, cost: BusinessCost | None = None) -> DataFrame:
    """Metrics of each (series_id, model) over all tested rows together."""
    return rows.groupBy("series_id", "model").agg(*point_metrics(), *(cost.aggregates() if cost else []))


@dataclass
class BacktestResult:
    """``quarantine``: (series_id, rule, reason) of the series that were left out, with the first rule that each breaks."""

    predictions: DataFrame
    folds: DataFrame
    fold_metrics: DataFrame
    models: tuple[str, ...]
    quarantine: DataFrame

    def model_names(self) -> tuple[str, ...]:
        return self.models


#: Rules of the quarantine, in the order in which they are tried.
SHORT, INVALID, CONSTANT = "too_short", "invalid_prediction", "constant_history"


def short_series(matrix: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """Quarantine rows of series too short for one fold."""
    sizes = matrix.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") <= config.first_test)
    reason = F.concat(F.lit("not enough observations: "), F.col("n").cast("string"), F.lit(f", and the first fold tests row {config.first_test}"))
    return sizes.select("series_id", F.lit(SHORT).alias("rule"), reason.alias("reason"))


def unfit_series(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Quarantine rows of series with a prediction that is missing or not finite, or (strict) a fold whose training labels never change."""
    found = rows.groupBy("series_id").agg(
        F.sort_array(F.collect_set(F.when(~is_finite(F.col("prediction")), F.col("model")))).alias("models"),
        F.min(F.when(F.col("mase_scale") <= EPSILON, F.col("fold"))).alias("fold"),
    )
    invalid = F.size("models") > 0
    rule = F.when(invalid, INVALID).when(F.col("fold").isNotNull() & F.lit(strict), CONSTANT)
    reason = F.when(invalid, F.concat(F.lit("invalid prediction vector: "), F.array_join("models", ", "))).otherwise(F.concat(F.lit("MASE is undefined for a constant training history: fold "), F.col("fold").cast("string")))
    return found.select("series_id", rule.alias("rule"), reason.alias("reason")).filter("rule IS NOT NULL")


class BacktestRunner:
    """Checks a supervised matrix, runs every model on every fold, and reports metrics.

    A series that can't be evaluated is put in the quarantine with its rule and reason, and the others go on: one with too few rows for
    one fold, one with an invalid prediction, and (``strict``) one with a constant training history, whose mase is undefined; not
    strict, its mase is null. Only if no series is left is the first one's reason raised. Predictions are written once, in the
    session's shared folder.
    """

    def __init__(self, config: WalkForwardConfig, models: dict[str, ModelSpec], *, target_column: str = TARGET, strict: bool = True):
        if not models:
            raise ValueError("at least one model factory is required")
        if reserved := {"actual", "fold"}.intersection(models):
            raise ValueError(f"reserved model names: {sorted(reserved)}")
        if not target_column:
            raise ValueError("target_column cannot be empty")
        self.config, self.models, self.target, self.strict = config, dict(models), target_column, strict

    def run(self, matrix: DataFrame) -> BacktestResult:
        scratch = Scratch(matrix.sparkSession, "backtest")
        matrix = scratch.write(matrix, "matrix")
        assert_no_leakage(matrix, self.target)
        sizes = matrix.groupBy("series_id").agg(F.count("*").alias("n"))
        longest, series = sizes.agg(F.max("n"), F.count("*")).first()
        self.config.count(longest)
        self.config.require_disjoint(longest)
        short = short_series(matrix, self.config)
        tested = matrix.join(short, "series_id", "left_anti")
        rows = scratch.write(predictions(tested, self.config, self.models, self.target), "predictions")
        quarantine = scratch.write(short.unionByName(unfit_series(rows, self.strict)), "quarantine")
        if quarantine.count() == series:
            raise ValueError(quarantine.orderBy("series_id").first()["reason"])
        kept = rows.join(quarantine, "series_id", "left_anti")
        folds = folds_of(matrix.join(quarantine, "series_id", "left_anti"), self.config)
        return BacktestResult(kept, folds, fold_metrics(kept), tuple(self.models), quarantine)

    def aggregate(self, result: BacktestResult, cost: BusinessCost | None = None) -> DataFrame:
        return pooled_metrics(result.predictions, cost)


def require_valid(rows: DataFrame) -> None:
    """Raises ValueError where a model's prediction is missing or not finite."""
    bad = rows.filter(~is_finite(F.col("prediction"))).select("model").distinct().limit(3).collect()
    if bad:
        raise ValueError(f"invalid prediction vector: {sorted(r['model'] for r in bad)}")


__all__ = ["BacktestResult", "BacktestRunner", "ModelSpec", "PREDICTION", "constant", "default_models", "fold_metrics", "gradient_boosting", "historical_mean", "learned", "pooled_metrics", "predictions", "repeated_tests", "require_valid", "ridge_regression", "seasonal_naive", "wide"]
