"""Forecast metrics as aggregate expressions over (actual, predicted), and functions that check and apply them.

Every expression is an ordinary Spark aggregate, so any grouping is one partial and one final aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import is_finite

EPSILON = 2.220446049250313e-16


def _pair(actual, predicted) -> tuple[Column, Column]:
    return tuple(F.col(x) if isinstance(x, str) else x for x in (actual, predicted))


def mae(actual="actual", predicted="prediction") -> Column:
    a, p = _pair(actual, predicted)
    return F.avg(F.abs(a - p))


def rmse(actual="actual", predicted="prediction") -> Column:
    a, p = _pair(actual, predicted)
    return F.sqrt(F.avg((a - p) * (a - p)))


def smape(actual="actual", predicted="prediction") -> Column:
    """Between 0 and 2; a term whose denominator is 0 counts as 0."""
    a, p = _pair(actual, predicted)
    size = F.abs(a) + F.abs(p)
    return F.avg(F.when(size > 0, F.lit(2.0) * F.abs(a - p) / size).otherwise(0.0))


def pinball(quantile: float, actual="actual", predicted="prediction") -> Column:
    if not 0 < quantile < 1:
        raise ValueError("quantile must be between 0 and 1")
    a, p = _pair(actual, predicted)
    return F.avg(F.greatest(F.lit(quantile) * (a - p), F.lit(quantile - 1) * (a - p)))


def directional_accuracy(actual="actual", predicted="prediction") -> Column:
    """Share of equal signs; zero matches zero only."""
    a, p = _pair(actual, predicted)
    return F.avg((F.signum(a) == F.signum(p)).cast("double"))


def interval_coverage(actual="actual", lower="lower", upper="upper") -> Column:
    return F.avg(F.col(actual).between(F.col(lower), F.col(upper)).cast("double"))


def interval_width(lower="lower", upper="upper") -> Column:
    return F.avg(F.col(upper) - F.col(lower))


@dataclass(frozen=True)
class BusinessCost:
    """Asymmetric cost of an error, plus the cost of acting on a forecast beyond a threshold."""

    underforecast_weight: float = 1.0
    overforecast_weight: float = 1.0
    action_threshold: float = 0.0
    action_cost: float = 0.0

    def __post_init__(self):
        if min(self.underforecast_weight, self.overforecast_weight, self.action_threshold, self.action_cost) < 0:
            raise ValueError("business-cost parameters cannot be negative")

    def cost(self, actual="actual", predicted="prediction") -> Column:
        a, p = _pair(actual, predicted)
        error = a - p
        base = F.when(error >= 0, error * self.underforecast_weight).otherwise(-error * self.overforecast_weight)
        return base + F.when(self.acts(p), F.lit(float(self.action_cost))).otherwise(0.0)

    def acts(self, predicted: Column) -> Column:
        return F.abs(predicted) > self.action_threshold

    def aggregates(self, actual="actual", predicted="prediction") -> list[Column]:
        _, p = _pair(actual, predicted)
        cost = self.cost(actual, predicted)
        return [F.avg(cost).alias("mean_business_cost"), F.sum(cost).alias("total_business_cost"), F.avg(self.acts(p).cast("double")).alias("action_rate")]


def point_metrics() -> list[Column]:
    return [mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape"), directional_accuracy().alias("directional_accuracy")]


def _checked(df: DataFrame, *columns: str) -> None:
    row = df.agg(F.count("*").alias("n"), *(F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    if not row["n"] or any(row[c] for c in columns):
        raise ValueError("metric inputs must be finite and non-empty")


def evaluate_pair(df: DataFrame, *metrics: Column, actual: str = "actual", predicted: str = "prediction"):
    """One row of metrics over two columns, which must be finite and non-empty."""
    _checked(df, actual, predicted)
    return df.agg(*metrics).first()


def evaluate_interval(df: DataFrame, actual: str = "actual", lower: str = "lower", upper: str = "upper") -> dict:
    """coverage and mean_width of intervals; a lower bound above the upper one is an error."""
    _checked(df, actual, lower, upper)
    row = df.agg(interval_coverage(actual, lower, upper), interval_width(lower, upper), F.count_if(F.col(lower) > F.col(upper))).first()
    if row[2]:
        raise ValueError("lower interval bounds exceed upper bounds")
    return {"coverage": row[0], "mean_width": row[1]}


def mase(df: DataFrame, training: DataFrame, order: str, seasonality: int = 1, actual="actual", predicted="prediction", target="target") -> float:
    """MAE of df over the mean absolute seasonal change of training, in the order of a column whose values are unique.

    Training rows are numbered and compared in ranges, so no task holds all of them.
    """
    from ..operators.baselines import changes
    from ..operators.ranges import numbered

    if seasonality < 1:
        raise ValueError("seasonality must be at least 1")
    _checked(training, target)
    rows = numbered(training.select(F.col(order).alias("order"), F.col(target).cast("double").alias("actual")), ["order"], "row_idx")
    n, scale = changes(rows.withColumn("series_id", F.lit("training")), seasonality).agg(F.count("*"), F.avg("change")).first()
    if n <= seasonality:
        raise ValueError("training history must exceed seasonality")
    if scale <= EPSILON:
        raise ValueError("MASE is undefined for a constant training history")
    return evaluate_pair(df, mae(actual, predicted), actual=actual, predicted=predicted)[0] / scale
