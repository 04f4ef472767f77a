"""Evaluation of trading on the sign of a forecast.

Wealth is a running product and drawdown rests on its running maximum. Both are scans of an associative operation, so they are made in
two levels: over the rows of a range of a series and model, and over one row for each range (its product, its
least and its greatest wealth, its last position). No task holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ranges import RANGE_ROWS, before_range

PERIODS = 252
_KEYS = ["series_id", "model"]


def strategy_path(rows: DataFrame, cost_bps: float = 5.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """position, turnover, gross, net, wealth and drawdown of each tested row.

    The first row's turnover is its own position. Drawdown is against the highest wealth so far, the first included,
    the initial capital not. A range is ``range_rows`` numbers of row_idx; prediction rows are written once, as both levels read them.
    """
    rows = rows.withColumns({"range": F.floor(F.col("row_idx") / F.lit(range_rows)), "position": F.signum("prediction")})
    rows = Scratch(rows.sparkSession, "strategy").write(rows, "rows")
    w = Window.partitionBy(*_KEYS, "range").orderBy("row_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # The position before a range is the last one of the range before.
    last = rows.groupBy(*_KEYS, "range").agg(F.max_by("position", "row_idx").alias("last"))
    held = before_range(last, _KEYS, held=F.last("last"))
    df = rows.join(held, [*_KEYS, "range"])
    df = df.withColumn("turnover", F.coalesce(F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), "held")), F.abs("position")))
    df = df.withColumn("gross", F.col("position") * F.col("actual")).withColumn("net", F.col("gross") - F.col("turnover") * F.lit(cost_bps / 10_000)).drop("held")
    df = df.withColumn("own", F.product(F.lit(1.0) + F.col("net")).over(so_far))
    # A wealth below 0 turns a range's least into its greatest.
    df = df.withColumns({"own_most": F.max("own").over(so_far), "own_least": F.min("own").over(so_far)})
    totals = df.groupBy(*_KEYS, "range").agg(F.max_by("own", "row_idx").alias("product"), F.max("own").alias("most"), F.min("own").alias("least"))
    started = totals.join(before_range(totals, _KEYS, start=F.product("product")), [*_KEYS, "range"]).withColumn("start", F.coalesce("start", F.lit(1.0)))
    peak = F.when(F.col("start") < 0, F.col("least")).otherwise(F.col("most")) * F.col("start")
    w_ranges = Window.partitionBy(*_KEYS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = started.select(*_KEYS, "range", "start", F.max(peak).over(w_ranges).alias("peak"))
    df = df.join(carried, [*_KEYS, "range"])
    high = F.greatest(F.col("peak"), F.when(F.col("start") < 0, F.col("own_least")).otherwise(F.col("own_most")) * F.col("start"))
    df = df.withColumn("wealth", F.col("start") * F.col("own"))
    return df.withColumn("drawdown", F.col("wealth") / high - 1).drop("range", "own", "own_most", "own_least", "start", "peak")


def strategy_metrics(rows: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """gross and net cumulative return, average turnover, Sharpe ratio (0 without deviation) and worst drawdown."""
    deviation = F.stddev_samp("net")
    sharpe = F.coalesce(F.when(deviation > 0, F.avg("net") * PERIODS / (deviation * F.sqrt(F.lit(float(PERIODS))))), F.lit(0.0))
    return strategy_path(rows, cost_bps).groupBy("series_id", "model").agg(
        (F.product(F.lit(1.0) + F.col("gross")) - 1).alias("gross_cumulative_return"),
        (F.max_by("wealth", "row_idx") - 1).alias("net_cumulative_return"),
        F.avg("turnover").alias("average_turnover"),
        sharpe.alias("strategy_sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )


def simple_metrics(rows: DataFrame) -> DataFrame:
    """The older report: mae, direction, and a Sharpe ratio without costs whose deviation has 1e-12 added."""
    gross = F.signum("prediction") * F.col("actual")
    return rows.groupBy("series_id", "model").agg(
        F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"),
        F.avg((F.signum("actual") == F.signum("prediction")).cast("double")).alias("directional_accuracy"),
        (F.sqrt(F.lit(float(PERIODS))) * F.avg(gross) / (F.stddev_samp(gross) + F.lit(1e-12))).alias("toy_strategy_sharpe"),
    )
