"""Baseline forecasters as plans: a row for each tested observation and model.

What a fold learns comes from a table of blocks, the rows between two folds' training ends: each block's sums are one aggregation over
the rows, and a fold merges its blocks in a window over blocks alone. Recent labels are gathered for the few rows before a
training end. So no training set is copied, no window runs over a series' rows, and all baselines share one pass.
Rows of a series are numbered without holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .features import TARGET
from .folds import WalkForwardConfig, fold_of, fold_table, test_rows
from .ranges import RANGE_ROWS, with_halo

PREDICTION = ("series_id", "ts", "row_idx", "fold", "model", "actual", "prediction")


def changes(rows: DataFrame, seasonality: int, size: int = RANGE_ROWS) -> DataFrame:
    """rows (series_id, row_idx, actual, ...) with ``change``, the absolute difference to the label ``seasonality`` rows before.

    In ranges of ``size`` rows and the labels before them, so no task holds a whole series.
    """
    w = Window.partitionBy("series_id", "range").orderBy("row_idx")
    df = with_halo(rows, "row_idx", seasonality, 0, size).withColumn("change", F.abs(F.col("actual") - F.lag("actual", seasonality).over(w)))
    return df.filter(~F.col("halo")).drop("range", "halo")


def learned_states(rows: DataFrame, config: WalkForwardConfig, seasonality: int = 1, seasons=()) -> DataFrame:
    """(series_id, fold, train_mean, mase_scale, recent_L ...) of each fold, of rows (series_id, row_idx, actual).

    Block k of a series is the rows that fold k trains and the fold before doesn't. Expanding folds train all blocks up to their own. A
    rolling fold trains the last ``max_train_size // step`` blocks, and of the one before them the rows at its end.
    """
    step, lead, size = config.step, config.min_train_size, config.max_train_size
    block = lambda shift: (F.floor((F.col("row_idx") - shift - lead) / F.lit(step)) + 1).cast("long")
    parts = []
    # A change belongs to a training set if its earlier row does.
    for name, shift, x in (("level", 0, "actual"), ("change", seasonality, "change")):
        whole, rest = divmod(size - shift, step) if size else (None, None)
        late = (F.col("row_idx") - lead) - (block(0) - 1) * step >= step - rest if size else F.lit(False)
        parts += [F.sum(x).alias(f"{name}_sum"), F.count(x).alias(f"{name}_n"), F.sum(F.when(late, F.col(x))).alias(f"{name}_late_sum"), F.count(F.when(late, F.col(x))).alias(f"{name}_late_n")]
    sums = changes(rows, seasonality).groupBy("series_id", block(0).alias("fold")).agg(*parts)
    w = Window.partitionBy("series_id").orderBy("fold")

    def mean(name: str, shift: int) -> Column:
        if not size:
            frame = w.rangeBetween(Window.unboundedPreceding, 0)
            return F.sum(f"{name}_sum").over(frame) / F.sum(f"{name}_n").over(frame)
        whole = (size - shift) // step
        edge = w.rangeBetween(-whole, -whole)
        total = [F.coalesce(F.sum(f"{name}_late_{part}").over(edge), F.lit(0)) for part in ("sum", "n")]
        if whole:
            frame = w.rangeBetween(1 - whole, 0)
            total = [t + F.coalesce(F.sum(f"{name}_{part}").over(frame), F.lit(0)) for t, part in zip(total, ("sum", "n"))]
        return F.try_divide(*total)

    learned = sums.select("series_id", "fold", mean("level", 0).alias("train_mean"), mean("change", seasonality).alias("mase_scale")).filter("fold >= 0")
    for season in seasons:
        # The rows before a training end at lead + fold * step; with steps shorter than a season a row lies before several.
        first = F.greatest(F.lit(0).cast("long"), block(0))
        near = rows.withColumn("fold", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("row_idx") - lead + season) / F.lit(step))))))
        near = near.filter(F.col("row_idx") >= lead + F.col("fold") * step - season)
        recent = near.groupBy("series_id", "fold").agg(F.sort_array(F.collect_list(F.struct("row_idx", "actual")))["actual"].alias(f"recent_{season}"))  # ``season`` labels
        learned = learned.join(recent, ["series_id", "fold"], "left")
    return learned


def _labels(matrix: DataFrame, target: str) -> DataFrame:
    """The label of each row as a written table: states and tested rows read it several times."""
    rows = matrix.select("series_id", "ts", "row_idx", F.col(target).cast("double").alias("actual"))
    return Scratch(matrix.sparkSession, "labels").write(rows, "labels")


def _require(config: WalkForwardConfig, seasonality: int, seasons) -> None:
    if seasonality < 1:
        raise ValueError("seasonality must be at least 1")
    if seasonality >= config.min_train_size:
        raise ValueError("training history must exceed seasonality")
    for season in seasons:
        require_season(season, config)


def fold_states(matrix: DataFrame, config: WalkForwardConfig, target: str = TARGET, seasonality: int = 1, seasons=()) -> DataFrame:
    """Tested rows (series_id, ts, row_idx, fold, actual) with what their fold has learned from its training rows.

    train_mean: of the label; mase_scale: mean absolute change over ``seasonality`` rows within them; recent_L for each
    season length L: the last L labels.
    """
    _require(config, seasonality, seasons)
    rows = _labels(matrix, target)
    learned = learned_states(rows.drop("ts"), config, seasonality, seasons)
    tested = rows.withColumn("fold", fold_of(F.col("row_idx"), config)).filter(F.col("fold").isNotNull())
    columns = ["train_mean", "mase_scale", *(f"recent_{n}" for n in seasons)]
    return tested.join(learned, ["series_id", "fold"], "left").select("series_id", "ts", "row_idx", "fold", "actual", *columns)


def require_season(season: int, config: WalkForwardConfig) -> None:
    if season < 1 or season > (config.max_train_size or config.min_train_size):
        raise ValueError("season_length must be at least 1 and fit the training history")


def seasonal(season: int, config: WalkForwardConfig) -> Column:
    """The last ``season`` training labels over and over from the first test row on; a gap does not move the phase."""
    start = F.col("fold") * config.step + config.first_test
    return F.element_at(f"recent_{season}", ((F.col("row_idx") - start) % season).cast("int") + 1)


def train_statistics(matrix: DataFrame, config: WalkForwardConfig, target: str = TARGET, seasonality: int = 1) -> DataFrame:
    """(series_id, fold, train_mean, mase_scale) of each fold."""
    _require(config, seasonality, ())
    rows = _labels(matrix, target)
    sizes = rows.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n"))
    folds = fold_table(sizes, config).select("series_id", "fold")
    return folds.join(learned_states(rows.drop("ts"), config, seasonality), ["series_id", "fold"], "left")


def folds_of(matrix: DataFrame, config: WalkForwardConfig) -> DataFrame:
    return fold_table(matrix.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n")), config)


def predict_constant(matrix, config, model="naive_zero", value: float = 0.0, target: str = TARGET) -> DataFrame:
    rows = test_rows(matrix, config).withColumns({"actual": F.col(target).cast("double"), "model": F.lit(model), "prediction": F.lit(float(value))})
    return rows.select(*PREDICTION)


def predict_historical_mean(matrix, config, model="historical_mean", target: str = TARGET) -> DataFrame:
    return fold_states(matrix, config, target).withColumns({"model": F.lit(model), "prediction": F.col("train_mean")}).select(*PREDICTION)


def predict_seasonal_naive(matrix, config, season: int = 5, model: str | None = None, target: str = TARGET) -> DataFrame:
    rows = fold_states(matrix, config, target, seasons=(season,))
    return rows.withColumns({"model": F.lit(model or f"seasonal_naive_{season}"), "prediction": seasonal(season, config)}).select(*PREDICTION)
