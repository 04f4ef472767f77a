"""Split-conformal intervals: the radius is an order statistic of earlier absolute residuals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import interval_coverage, interval_width, pinball
from ..functions.scalar import is_finite
from ..scratch import Scratch
from .selection import kth_smallest

METHOD = "split_conformal_absolute_residual"


def conformal_rank(n: int, coverage: float) -> int:
    return min(n, math.ceil((n + 1) * coverage))


def require_coverage(coverage: float) -> None:
    if not 0 < coverage < 1:
        raise ValueError("coverage must be between 0 and 1")


def require_intervals(rows: DataFrame) -> None:
    """Raises ValueError unless lower <= point <= upper, all finite, and 0 < coverage < 1 in every row."""
    ordered = (F.col("lower") <= F.col("point")) & (F.col("point") <= F.col("upper"))
    fine = is_finite(F.col("lower")) & is_finite(F.col("upper")) & F.coalesce(ordered, F.lit(False)) & (F.col("coverage") > 0) & (F.col("coverage") < 1)
    if not rows.filter(~F.coalesce(fine, F.lit(False))).isEmpty():
        raise ValueError("an interval has to hold its point between finite bounds, with a coverage between 0 and 1")


def split_segments(rows: DataFrame, share: float = 0.4) -> DataFrame:
    """Adds ``calibrates``: true for the first max(2, int(share * n)) tested rows of each series and model.

    The last of them is found by selection, not by numbering a series' rows.
    """
    edge = kth_smallest(rows, ["series_id", "model"], "row_idx", lambda n: F.greatest(F.lit(2), F.floor(n * F.lit(share))))
    edge = edge.select("series_id", "model", F.col("row_idx").alias("_edge"))
    return rows.join(edge, ["series_id", "model"]).withColumn("calibrates", F.col("row_idx") <= F.col("_edge")).select(*rows.columns, "calibrates")


def conformal_radius(rows: DataFrame, coverage: float = 0.9) -> DataFrame:
    """(series_id, model, calibration_size, radius): the ceil((n + 1) * coverage)-th smallest absolute residual, by selection.

    Rows without a residual (a null) are not counted.
    """
    residuals = rows.select("series_id", "model", F.abs(F.col("actual") - F.col("prediction")).alias("radius"))
    found = kth_smallest(residuals, ["series_id", "model"], "radius", lambda n: F.ceil((n + 1).cast("double") * F.lit(float(coverage))))
    return found.select("series_id", "model", F.col("n").alias("calibration_size"), "radius")


def intervals(rows: DataFrame, radius: DataFrame, coverage: float = 0.9) -> DataFrame:
    """point, lower, upper and coverage of each row; one radius for each series and model is joined."""
    require_coverage(coverage)
    df = rows.join(radius.select("series_id", "model", "radius"), ["series_id", "model"])
    point = F.col("prediction")
    return df.select("series_id", "ts", "row_idx", "model", "actual", point.alias("point"), (point - F.col("radius")).alias("lower"), (point + F.col("radius")).alias("upper"), F.lit(float(coverage)).alias("coverage"))


def interval_evaluation(rows: DataFrame, coverage: float = 0.9, share: float = 0.4) -> DataFrame:
    """Radius from the earlier segment of each series and model; coverage, width and pinball losses on the later one."""
    rows = Scratch(rows.sparkSession, "intervals").write(rows, "rows")  # read for the split, the radius and the intervals
    split = split_segments(rows, share)
    radius = conformal_radius(split.filter("calibrates"), coverage)
    made = intervals(split.filter(~F.col("calibrates")), radius, coverage)
    low, high = (1 - coverage) / 2, (1 + coverage) / 2
    low, high = round(low, 12), round(high, 12)
    scores = made.groupBy("series_id", "model").agg(interval_coverage().alias("coverage"), interval_width().alias("mean_width"), pinball(low, "actual", "lower").alias("lower_pinball_loss"), pinball(high, "actual", "upper").alias("upper_pinball_loss"), F.count("*").alias("evaluation_size"))
    return radius.join(scores, ["series_id", "model"])


class SplitConformalCalibrator:
    """Fits one radius on (actual, prediction) rows and widens points by it."""

    def __init__(self, coverage: float = 0.9):
        require_coverage(coverage)
        self.coverage, self.size, self.radius = coverage, None, None

    def fit(self, rows: DataFrame) -> SplitConformalCalibrator:
        residual = F.abs(F.col("actual") - F.col("prediction"))
        n, bad = rows.agg(F.count("*"), F.count_if(~is_finite(residual))).first()
        if n < 2:
            raise ValueError("calibration needs at least two residuals")
        if bad:
            raise ValueError("calibration residuals must be finite")
        one = rows.select(F.lit("one").alias("series_id"), F.lit("one").alias("model"), "actual", "prediction")
        self.size, self.radius = n, conformal_radius(one, self.coverage).first()["radius"]
        return self

    def predict(self, points: DataFrame, column: str = "prediction") -> DataFrame:
        if self.radius is None:
            raise RuntimeError("the calibrator must be fitted before predict")
        n, bad = points.agg(F.count("*"), F.count_if(~is_finite(F.col(column)))).first()
        if not n or bad:
            raise ValueError("points must be a finite, non-empty vector")
        return points.withColumns({"lower": F.col(column) - self.radius, "upper": F.col(column) + self.radius})

    def metadata(self) -> dict:
        if self.radius is None:
            raise RuntimeError("the calibrator must be fitted before metadata")
        return {"method": METHOD, "target_coverage": self.coverage, "calibration_size": self.size, "radius": self.radius}
