"""Fail-closed checks of observations: one aggregate for each check set, inspected in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite


def quality_report(observations: DataFrame) -> DataFrame:
    """For each series: observations, missing and repeated times, bad closes and bad volumes."""
    volume = "volume" in observations.columns
    close = F.col("close").cast("double")
    bad_volume = F.count_if(~is_finite(F.col("volume").cast("double")) | (F.col("volume") < 0)) if volume else F.lit(0)
    # Times are counted before series are, so no task holds the times of a whole series.
    times = observations.groupBy("series_id", "ts").agg(F.count("*").alias("n"), F.count_if(~is_finite(close) | (close <= 0)).alias("bad_close"), bad_volume.alias("bad_volume"))
    return times.groupBy("series_id").agg(
        F.sum("n").alias("observations"),
        F.sum(F.when(F.col("ts").isNull(), F.col("n")).otherwise(0)).alias("missing_times"),
        F.sum(F.when(F.col("ts").isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeated_times"),
        F.sum("bad_close").alias("bad_close"),
        F.sum("bad_volume").cast("long").alias("bad_volume"),
    )


def require_observations(observations: DataFrame) -> int:
    """Raises TypeError or ValueError for observations that are missing, repeated or out of range; the longest series' observations."""
    if missing := [c for c in ("series_id", "ts", "close") if c not in observations.columns]:
        raise TypeError(f"observations need the columns {missing}")
    sums = (F.sum(c).alias(c) for c in ("observations", "missing_times", "repeated_times", "bad_close", "bad_volume"))
    r = quality_report(observations).agg(*sums, F.max("observations").alias("longest")).first()
    if not r["observations"]:
        raise ValueError("close must contain observations")
    if r["missing_times"]:
        raise ValueError("close has invalid timestamps")
    if r["repeated_times"]:
        raise ValueError("close must have a unique, increasing index")
    if r["bad_close"]:
        raise ValueError("close must be finite and strictly positive")
    if r["bad_volume"]:
        raise ValueError("volume must be finite and non-negative")
    return r["longest"]
