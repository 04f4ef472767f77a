"""Learned forecasters.

Ridge regression comes from centred moments of blocks of rows, merged from fold to fold: no training row is
copied. Any other learner is a function ``(train_x, train_y, test_x) -> predictions`` on numpy arrays, which a pandas task calls
for a run of folds of a series, slicing the rows that they share.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, partitions
from .features import TARGET
from .folds import WalkForwardConfig, fold_of, test_rows
from .moments import Moments, windows

Learner = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Folds fitted by one task.
RUN = 8
#: Folds of ridge solved by one task.
FOLD_RANGE = 512
_BLOCK = "series_id string, first long, last long, state array<double>"
KEY_COLUMNS = ("series_id", "ts", "row_idx", "fold")


def ridge(alpha: float = 3.0) -> Learner:
    """Least squares with an L2 penalty on standardised features (population deviation, 1 where it is 0) and an intercept."""

    def learn(x, y, new):
        x, new = x - x[0], new - x[0]  # an offset costs no digits
        mean, scale = x.mean(0), x.std(0)
        scale = np.where((scale > 0) & (x != 0).any(0), scale, 1.0)
        z = (x - mean) / scale
        weights = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        return (new - mean) / scale @ weights + y.mean()

    return learn


def boosting(rounds: int = 100, depth: int = 3, rate: float = 0.05, l2: float = 0.5, bins: int = 255, least: int = 20) -> Learner:
    """Gradient boosting of squared loss with histogram trees.

    A feature's bins end at its quantiles; a split maximises G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2), a leaf is
    -G / (H + l2). Ties go to the first feature and bin, so a fit is deterministic.
    """

    def edges_of(x):
        distinct = np.unique(x)
        if len(distinct) <= bins:
            return (distinct[1:] + distinct[:-1]) / 2
        return np.unique(np.quantile(x, np.arange(1, bins) / bins))

    def learn(x, y, new):
        edges = [edges_of(c) for c in x.T]
        code = lambda m: np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, m.T)], 1)
        train, test = code(x), code(new)
        n, width = train.shape
        size = max(len(e) for e in edges) + 1
        flat = train + np.arange(width) * size
        fit, out = np.full(n, y.mean()), np.full(len(new), y.mean())
        cells = width * size
        root = np.bincount(flat.ravel(), minlength=cells)  # in every round
        for _ in range(rounds):
            gradient = fit - y
            weights = np.repeat(gradient, width)
            node, fresh = np.zeros(n, np.int64), np.zeros(len(new), np.int64)
            for level in range(depth):  # all nodes of a level at once; one that isn't split hands its rows to its left child
                m = 1 << level
                at = (node[:, None] * cells + flat).ravel() if level else flat.ravel()
                gs = np.bincount(at, weights, m * cells).reshape(m, width, size).cumsum(2)
                hs = (np.bincount(at, minlength=m * cells) if level else root).reshape(m, width, size).cumsum(2)
                g, h = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g * g / (h + l2)
                gain[(hs < least) | (h - hs < least)] = -np.inf
                gain = gain.reshape(m, cells)
                best = gain.argmax(1)
                feature, edge = np.divmod(best, size)
                edge = np.where(gain[np.arange(m), best] > 1e-12, edge, size)
                node = 2 * node + (train[np.arange(n), feature[node]] > edge[node])
                fresh = 2 * fresh + (test[np.arange(len(new)), feature[fresh]] > edge[fresh])
            step = -rate * np.bincount(node, gradient, 1 << depth) / (np.bincount(node, minlength=1 << depth) + l2)
            fit += step[node]
            out += step[fresh]
        return out

    return learn


def feature_names(matrix: DataFrame, target: str) -> list[str]:
    return [c for c in matrix.columns if c not in (*KEY_COLUMNS, target)]


def trained_folds(rows: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """rows (series_id, row_idx, ...) with the ``first`` and the ``last`` fold that each trains; last is below first if there is none."""
    i, step = F.col("row_idx"), F.lit(config.step)
    sizes = rows.groupBy("series_id").agg((F.max("row_idx") + 1).alias("n"))
    last = F.ceil((F.col("n") - config.first_test) / step).cast("long") - 1
    first = F.greatest(F.lit(0).cast("long"), F.floor((i - config.min_train_size) / step).cast("long") + 1)
    if config.max_train_size:
        last = F.least(last, F.floor((i + config.max_train_size - config.min_train_size) / step).cast("long"))
    return rows.join(sizes, "series_id").withColumns({"first": first, "last": last}).drop("n")


def predict_learned(matrix: DataFrame, config: WalkForwardConfig, model: str, learner: Learner, target: str = TARGET) -> DataFrame:
    """Predictions of a learner fitted on each fold's training rows; a task holds the rows of a run of folds of one series."""
    features = feature_names(matrix, target)
    step, lead, most = config.step, config.min_train_size, config.max_train_size
    rows = matrix.select("series_id", "ts", "row_idx", *(F.col(c).cast("double").alias(c) for c in (*features, target)))
    rows, tests = trained_folds(rows, config), fold_of(F.col("row_idx"), config)
    rows = rows.withColumns({"k0": F.least("first", F.coalesce(tests, "first")), "k1": F.greatest("last", F.coalesce(tests, "last"))}).drop("first", "last").filter("k0 <= k1")
    rows = rows.withColumn("run", F.explode(F.sequence(F.floor(F.col("k0") / RUN), F.floor(F.col("k1") / RUN)))).drop("k0", "k1")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", ignore_index=True)
        at, x, y = pdf["row_idx"].to_numpy(), pdf[features].to_numpy(), pdf[target].to_numpy()
        out = []
        for fold in range(key[1] * RUN, (key[1] + 1) * RUN):
            end, start = lead + fold * step, config.first_test + fold * step
            a, b, c, d = np.searchsorted(at, [max(0, end - most) if most else 0, end, start, start + config.test_size])
            if c < d:
                predicted = np.asarray(learner(x[a:b], y[a:b], x[c:d]), float)
                if predicted.shape != (d - c,) or not np.isfinite(predicted).all():
                    raise ValueError(f"{model} returned an invalid prediction vector")
                out.append(pdf[["series_id", "ts", "row_idx"]][c:d].assign(fold=fold, model=model, actual=y[c:d], prediction=predicted))
        return pd.concat(out) if out else pdf[:0].assign(fold=0, model=model, actual=0.0, prediction=0.0)[["series_id", "ts", "row_idx", "fold", "model", "actual", "prediction"]]

    time = dict(matrix.dtypes)["ts"]
    # By number, or few bytes would make one task of all fits.
    rows = rows.repartition(4 * partitions(matrix.sparkSession), "series_id", "run")
    return rows.groupBy("series_id", "run").applyInPandas(fit, f"series_id string, ts {time}, row_idx long, fold long, model string, actual double, prediction double")


def predict_ridge(matrix: DataFrame, config: WalkForwardConfig, model: str = "ridge", alpha: float = 3.0, target: str = TARGET) -> DataFrame:
    """Ridge predictions, as of ``ridge``, from centred moments of blocks of rows that train the same folds.

    A task makes the moments of its rows' blocks. Folds are dealt out in ranges of ``FOLD_RANGE``, which tasks solve fold by fold: a range of rolling
    folds gets each block that lives in it; one of expanding folds its own blocks and the merged moments of all before.
    Weights are joined to the tested rows. So no task holds more of a series than one range of folds and the
    moments of its ranges, and no training row is copied.
    """
    features = feature_names(matrix, target)
    width = len(features) + 1
    i, step = F.col("row_idx"), F.lit(config.step)
    first = F.greatest(F.lit(0).cast("long"), F.floor((i - config.min_train_size) / step).cast("long") + 1)
    last = F.floor((i + config.max_train_size - config.min_train_size) / step).cast("long") if config.max_train_size else F.lit(2**62).cast("long")
    rows = matrix.select("series_id", first.alias("first"), last.alias("last"), F.array(*(F.col(c).cast("double") for c in (*features, target))).alias("v"))

    def add(frames):
        for pdf in frames:
            if len(pdf):
                block = pdf.groupby(["series_id", "first", "last"], sort=False, dropna=False).ngroup().to_numpy()
                order = np.argsort(block, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(block[order]) > 0])
                v = np.stack(pdf["v"].to_numpy()[order])
                yield pdf.iloc[order[starts]][["series_id", "first", "last"]].assign(state=[Moments.of(part).pack() for part in np.split(v, starts[1:])])

    blocks = rows.filter("first <= last").mapInPandas(add, _BLOCK)
    size = max(FOLD_RANGE, -(-(config.max_train_size or 0) // config.step))  # a rolling block lives in two ranges at most
    own = F.floor(F.col("first") / size)
    if config.max_train_size:
        dealt = blocks.withColumn("range", F.explode(F.sequence(own, F.floor(F.col("last") / size))))
    else:
        dealt = Scratch(matrix.sparkSession, "ridge").write(blocks.withColumn("range", own), "blocks")
        dealt = dealt.unionByName(_moments_before(dealt, width))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "last"])
        alive = zip(pdf["first"].tolist(), pdf["last"].tolist(), (Moments.unpack(x, width) for x in pdf["state"]))
        steps = range(key[1] * size, min((key[1] + 1) * size, int(pdf["first"].max()) + 1))
        out = [(key[0], fold, *merged.ridge(alpha)) for fold, merged in windows(alive, steps) if merged]
        return pd.DataFrame(out, columns=["series_id", "fold", "weights", "centre", "value"])

    weights = dealt.groupBy("series_id", "range").applyInPandas(solve, "series_id string, fold long, weights array<double>, centre array<double>, value double")
    tested = test_rows(matrix, config).withColumn("x", F.array(*(F.col(c).cast("double") for c in features)))
    away = F.zip_with("x", "centre", lambda a, b: a - b)
    value = F.aggregate(F.zip_with(away, "weights", lambda a, b: a * b), F.col("value"), lambda a, b: a + b)
    return tested.join(weights, ["series_id", "fold"]).select("series_id", "ts", "row_idx", "fold", F.lit(model).alias("model"), F.col(target).cast("double").alias("actual"), value.alias("prediction"))


def _moments_before(blocks: DataFrame, width: int) -> DataFrame:
    """For each range of a series' folds but the first, the merged moments of all blocks of the ranges before, as a block."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        states = (Moments.unpack(x, width) for x in pdf.sort_values("first")["state"])
        return pd.DataFrame({"series_id": [key[0]], "first": [0], "last": [2**62], "state": [reduce(Moments.__add__, states).pack()], "range": [key[1]]})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range")
        states = accumulate((Moments.unpack(x, width) for x in pdf["state"]), Moments.__add__)
        return pdf.assign(state=[s.pack() for s in states], range=pdf["range"] + 1)

    schema = _BLOCK + ", range long"
    return blocks.groupBy("series_id", "range").applyInPandas(merge, schema).groupBy("series_id").applyInPandas(run, schema)
