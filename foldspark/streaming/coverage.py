"""A streaming monitor: how often incoming outcomes fall within their forecast intervals, by event-time window.

An extension for use behind a batch calibration; it holds one row of state for each open window, series and model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_coverage(outcomes: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Coverage and mean width of (series_id, model, ts timestamp, actual, lower, upper) in each window of ts.

    Works on streams, where rows more than ``late`` behind the newest are dropped, and on tables alike.
    """
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")
    by = outcomes.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window).alias("w"), "series_id", "model")
    made = by.agg(F.count("*").alias("outcomes"), F.avg(inside).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "series_id", "model", "outcomes", "coverage", "mean_width")
