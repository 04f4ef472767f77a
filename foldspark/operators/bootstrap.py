"""Circular moving-block bootstrap of a difference of mean absolute errors, for any number of series at once.

Length, block size and number of blocks are columns of a series. The sum of the block at each start is a difference of running sums,
joined row to row, so a sample is a number of block sums: samples x blocks rows are added up instead of samples x
observations. Running sums are made in two levels, within ranges and over them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..scratch import Scratch
from .ranges import RANGE_ROWS, before_range

METHOD = "circular_moving_block_bootstrap"


def default_block(n: int) -> int:
    return max(1, min(n, math.ceil(n ** (1 / 3))))


def loss_difference(rows: DataFrame, a: str, b: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(series_id, i, d): |error of a| - |error of b| of each tested row that has both models, numbered from 0 in order of row_idx."""
    error = F.abs(F.col("actual") - F.col("prediction"))
    both = rows.filter(F.col("model").isin(a, b)).groupBy("series_id", "row_idx").agg(F.max(F.when(F.col("model") == a, error)).alias("ea"), F.max(F.when(F.col("model") == b, error)).alias("eb"))
    both = both.select("series_id", "row_idx", F.floor(F.col("row_idx") / F.lit(range_rows)).alias("range"), (F.col("ea") - F.col("eb")).alias("d"))
    w = Window.partitionBy("series_id", "range").orderBy("row_idx")
    before = before_range(both.groupBy("series_id", "range").agg(F.count("*").alias("n")), ["series_id"], before=F.sum("n"))
    placed = both.withColumn("i", F.row_number().over(w) - 1).join(before, ["series_id", "range"])
    return placed.select("series_id", (F.col("i") + F.coalesce("before", F.lit(0))).cast("long").alias("i"), "d")


def sampling_plan(diff: DataFrame, block_size: int | None = None) -> DataFrame:
    """(series_id, n, block, blocks) of each series; blocks of the cube root of n, or of a fixed size but no longer than the series."""
    n = F.col("n")
    # The cube root of a cube may come out a little high.
    root = F.ceil(F.cbrt(n.cast("double")) - 1e-9)
    block = F.least(n, F.lit(block_size)) if block_size else F.least(n, root)
    plan = diff.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("block", F.greatest(F.lit(1), block).cast("long"))
    return plan.withColumn("blocks", F.ceil(n / F.col("block")).cast("long"))


def block_sums(diff: DataFrame, plan: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(series_id, start, full, tail): sums of the block at each start, and of the shorter last block of a sample."""
    ranged = diff.withColumn("range", F.floor(F.col("i") / F.lit(range_rows)))
    w = Window.partitionBy("series_id", "range").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("series_id", "range").agg(F.sum("d").alias("total"))
    ahead = before_range(totals, ["series_id"], ahead=F.sum("total"))
    run = ranged.withColumn("run", F.coalesce(F.sum("d").over(w), F.lit(0.0))).join(ahead, ["series_id", "range"])
    run = run.select("series_id", "i", (F.col("run") + F.coalesce("ahead", F.lit(0.0))).alias("run"))
    whole = diff.groupBy("series_id").agg(F.sum("d").alias("all"))
    each = run.join(plan.join(whole, "series_id"), "series_id")
    starts = each.select("series_id", F.col("i").alias("start"), "run", "n", "block", (F.col("n") - (F.col("blocks") - 1) * F.col("block")).alias("rest"), "all")
    ends = run.select("series_id", F.col("i").alias("end"), F.col("run").alias("end_run"))

    def up_to(df: DataFrame, length: Column, name: str) -> DataFrame:
        """The sum of ``length`` values from each start on, around the end of the series."""
        end = F.col("start") + length
        joined = df.withColumn("end", F.pmod(end, F.col("n"))).join(ends, ["series_id", "end"])
        return joined.withColumn(name, F.col("end_run") - F.col("run") + F.when(end >= F.col("n"), F.col("all")).otherwise(0.0)).drop("end", "end_run")

    return up_to(up_to(starts, F.col("block"), "full"), F.col("rest"), "tail").select("series_id", "start", "full", "tail")


def _grid(plan: DataFrame, samples: int) -> DataFrame:
    grid = plan.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    return grid.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))


def arithmetic_starts(plan: DataFrame, samples: int) -> DataFrame:
    """Starts by integer arithmetic, the same in any engine: (sample * 7919 + block * 104729 + sample * block * 31) mod n."""
    s, b = F.col("sample"), F.col("block_no")
    return _grid(plan, samples).withColumn("start", (s * 7919 + b * 104729 + s * b * 31) % F.col("n"))


def random_starts(plan: DataFrame, samples: int, seed: int) -> DataFrame:
    """Starts by a hash of (seed, series, sample, block), the same in every run and for any set of series."""
    return _grid(plan, samples).withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "series_id", "sample", "block_no"), F.col("n")))


def sample_means(sums: DataFrame, starts: DataFrame) -> DataFrame:
    """(series_id, sample, mean_difference) for starts of (series_id, n, blocks, sample, block_no, start)."""
    part = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("tail")).otherwise(F.col("full"))
    return starts.join(sums, ["series_id", "start"]).groupBy("series_id", "sample").agg((F.sum(part) / F.first("n")).alias("mean_difference"))


def bootstrap_intervals(diff: DataFrame, plan: DataFrame, starts: DataFrame) -> DataFrame:
    """(series_id, observations, block_size, observed_mae_difference, bootstrap_p05, bootstrap_p95, bootstrap_mean) of each series.

    A percentile holds the samples of one series: as many as the parameter says.
    """
    means = sample_means(block_sums(diff, plan), starts).groupBy("series_id").agg(*(F.percentile("mean_difference", F.lit(p)).alias(f"bootstrap_p{100 * p:02.0f}") for p in (0.05, 0.95)), F.avg("mean_difference").alias("bootstrap_mean"))
    observed = diff.groupBy("series_id").agg(F.avg("d").alias("observed_mae_difference"))
    about = plan.select("series_id", F.col("n").alias("observations"), F.col("block").alias("block_size"))
    return about.join(observed, "series_id").join(means, "series_id")


def panel_bootstrap(rows: DataFrame, a: str, b: str, *, samples: int = 3000, block_size: int | None = None, seed: int = 42) -> DataFrame:
    """``bootstrap_intervals`` of each series of prediction rows; a series with a missing or infinite error in a's or b's rows has none."""
    diff = Scratch(rows.sparkSession, "bootstrap").write(loss_difference(rows, a, b), "differences")
    bad = diff.filter(~is_finite(F.col("d"))).select("series_id").distinct()
    diff = diff.join(bad, "series_id", "left_anti")
    plan = sampling_plan(diff, block_size)
    return bootstrap_intervals(diff, plan, random_starts(plan, samples, seed))


def paired_bootstrap(rows: DataFrame, a: str, b: str, *, samples: int = 3000, block_size: int | None = None, seed: int = 42) -> dict:
    """Observed difference of a's and b's MAE and the 5 % and 95 % points of its bootstrap distribution, for one series."""
    if isinstance(samples, bool) or not isinstance(samples, int) or samples < 1:
        raise ValueError("samples must be a positive integer")
    diff = Scratch(rows.sparkSession, "bootstrap").write(loss_difference(rows, a, b), "differences")
    n, missing = diff.agg(F.count("*"), F.count_if(~is_finite(F.col("d")))).first()
    if not n or missing:
        raise ValueError("paired vectors need the same rows, at least one, and finite errors")
    if block_size is not None and (isinstance(block_size, bool) or not isinstance(block_size, int) or not 1 <= block_size <= n):
        raise ValueError("block_size must be an integer between 1 and the number of observations")
    plan = sampling_plan(diff, block_size)
    r = bootstrap_intervals(diff, plan, random_starts(plan, samples, seed)).first()
    return {"method": METHOD, "samples": samples, **{k: r[k] for k in ("block_size", "observed_mae_difference", "bootstrap_p05", "bootstrap_p95")}}
