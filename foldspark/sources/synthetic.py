"""Synthetic series: business days, regimes of autoregressive returns with a slow wave, lognormal volume.

Shocks are drawn on the driver in a fixed order of numpy's default generator; the recursion, which each row needs the
last row's result for, runs in one pandas task for each series.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KIND = "deterministic_synthetic_regime_shift"


@dataclass(frozen=True)
class Regime:
    """Until this share of the rows (exclusive): autoregression and deviation of the shock."""

    until: float
    phi: float
    sigma: float


#: Fixed values.
REGIMES = (Regime(0.35, 0.12, 0.010), Regime(0.70, -0.08, 0.016), Regime(float("inf"), 0.05, 0.008))
WAVE, PERIOD = 0.0015, 17.0
VOLUME_MEAN, VOLUME_DEVIATION = 14.8, 0.30
FIRST_DAY = date(2021, 1, 4)


def business_days(n: int, first: date = FIRST_DAY) -> list[date]:
    out, day = [], first
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(1)
    return out


def _by_regime(i: Column, n: Column, value: str, regimes=REGIMES) -> Column:
    out = F.lit(float(getattr(regimes[-1], value)))
    for r in reversed(regimes[:-1]):
        out = F.when(i < n * F.lit(r.until), F.lit(float(getattr(r, value)))).otherwise(out)
    return out


def regime_returns(shocks: DataFrame, regimes=REGIMES, wave: float = WAVE) -> DataFrame:
    """(series_id, i, return) from standard-normal shocks (series_id, i, z): r_i = phi r_(i-1) + wave + sigma z_i, r_0 = 0."""
    size = F.count("*").over(Window.partitionBy("series_id"))
    i = F.col("i")
    terms = shocks.withColumn("n", size).select("series_id", "i", _by_regime(i, F.col("n"), "phi", regimes).alias("phi"), (F.lit(wave) * F.sin(i / F.lit(PERIOD)) + _by_regime(i, F.col("n"), "sigma", regimes) * F.col("z")).alias("push"))

    def recur(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        last, out = 0.0, np.zeros(len(pdf))
        for k, (index, phi, push) in enumerate(zip(pdf["i"], pdf["phi"], pdf["push"])):
            last = out[k] = phi * last + push if index else 0.0
        return pdf[["series_id", "i"]].assign(**{"return": out})

    return terms.groupBy("series_id").applyInPandas(recur, "series_id string, i long, `return` double")


def _check(rows, least: int) -> None:
    if isinstance(rows, bool) or not isinstance(rows, int):
        raise TypeError("rows must be an integer")
    if rows < least:
        raise ValueError(f"rows must be at least {least}")


def synthetic_market(spark: SparkSession, rows: int = 1100, seed: int = 42, series_id: str = "synthetic") -> DataFrame:
    """Observations (series_id, ts, close, volume): all volumes are drawn first, then one shock for each later row."""
    _check(rows, 2)
    rng = np.random.default_rng(seed)
    volume = rng.lognormal(VOLUME_MEAN, VOLUME_DEVIATION, rows)
    z = np.append(0.0, rng.normal(0.0, 1.0, rows - 1))
    days = business_days(rows)
    base = spark.createDataFrame([(series_id, i, days[i], float(z[i]), float(volume[i])) for i in range(rows)], "series_id string, i long, ts date, z double, v double").coalesce(1)
    returns = regime_returns(base.select("series_id", "i", "z"))
    w = Window.partitionBy("series_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = base.join(returns, ["series_id", "i"]).withColumn("close", F.lit(100.0) * F.exp(F.sum("return").over(w)))
    scaled = F.col("v") * F.when(F.col("i") == 0, 1.0).otherwise(F.lit(1.0) + F.least(F.lit(2.0), F.abs("return") * 25))
    return df.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "close", scaled.alias("volume"))


def simple_market(spark: SparkSession, rows: int = 900, seed: int = 11, series_id: str = "simple") -> DataFrame:
    """The older series: one regime (0.08, 0.012), no wave, no volume, from the first business day of 2021."""
    _check(rows, 2)
    z = np.random.default_rng(seed).normal(0.0, 1.0, rows)
    days = business_days(rows, date(2021, 1, 1))
    shocks = spark.createDataFrame([(series_id, i, days[i], float(z[i])) for i in range(rows)], "series_id string, i long, ts date, z double").coalesce(1)
    returns = regime_returns(shocks.select("series_id", "i", "z"), (Regime(float("inf"), 0.08, 0.012),), 0.0)
    w = Window.partitionBy("series_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = shocks.join(returns, ["series_id", "i"])
    return df.select("series_id", F.col("ts").cast("timestamp").alias("ts"), (F.lit(100.0) * F.exp(F.sum("return").over(w))).alias("close"))
