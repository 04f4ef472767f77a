"""Gradient boosting of long series: histograms of gradients summed by Spark, level by level, for all folds at once.

The rows of a fold lie in chunks, binned once by the fold's own edges. For each level of a tree a task sums gradients and counts of its
chunks by (node, feature, bin); Spark adds the sums up, and each fold's best splits are chosen from at most nodes x
features x bins of them. A tree is a row of a table, joined to the chunks. So a fit uses all tasks however few the
series are, and nothing reaches the driver. The trees are those of ``learners.boosting``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .features import TARGET
from .folds import WalkForwardConfig, fold_of
from .learners import boosting, feature_names, predict_learned, trained_folds

#: Rows of a chunk, and the longest series that ``predict_boosting`` fits in one task for each run of folds.
CHUNK_ROWS, LOCAL_ROWS = 1 << 14, 1 << 18
#: Bins are bytes; this edge sends every row to the left.
NOWHERE = 256
_STATE = "series_id string, fold long, at array<long>, codes binary, y binary, train binary, fit binary"


def fold_edges(rows: DataFrame, features: list[str], bins: int) -> DataFrame:
    """(series_id, fold, edges array<array<double>>): the borders of each feature's bins, from the training rows of a fold.

    Midpoints of the distinct values where there are at most ``bins``, as ``learners.boosting`` has them; else quantiles from Spark's sketch.
    """
    grid = [i / bins for i in range(1, bins)]
    aggregates = [F.struct(F.approx_count_distinct(c).alias("distinct"), F.percentile_approx(c, grid, 100 * bins).alias("quantiles")).alias(c) for c in features]
    sketched = rows.groupBy("series_id", "fold").agg(*aggregates)
    # Features with few values by the sketch (its error is a few hundredths) are counted exactly; their sets are small.
    values = rows.join(sketched.select("series_id", "fold", *(F.col(c)["distinct"].alias(f"n {c}") for c in features)), ["series_id", "fold"])
    sets = values.groupBy("series_id", "fold").agg(*(F.sort_array(F.collect_set(F.when(F.col(f"n {c}") <= 2 * bins, F.col(c)))).alias(f"set {c}") for c in features))

    def borders(c: str):
        few = F.col(f"set {c}")
        middles = F.zip_with(F.slice(few, 1, F.greatest(F.lit(0), F.size(few) - 1)), F.slice(few, 2, F.greatest(F.lit(0), F.size(few) - 1)), lambda a, b: (a + b) / 2)
        return F.when((F.size(few) > 0) & (F.size(few) <= bins), middles).otherwise(F.array_sort(F.array_distinct(F.col(c)["quantiles"])))

    return sketched.join(sets, ["series_id", "fold"]).select("series_id", "fold", F.array(*(borders(c) for c in features)).alias("edges"))


def _chunks(rows: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """The rows (train true or false) of each fold as binned chunks whose fit is the mean training label."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        return pd.DataFrame({"series_id": [key[0]], "fold": [key[1]], "at": [pdf["row_idx"].to_numpy()], "x": [pdf[features].to_numpy(float).tobytes()], "y": [pdf["y"].to_numpy(float).tobytes()], "train": [pdf["train"].to_numpy().astype(np.uint8).tobytes()]})

    packed = rows.withColumn("chunk", F.floor(F.col("row_idx") / F.lit(CHUNK_ROWS))).groupBy("series_id", "fold", "chunk").applyInPandas(pack, "series_id string, fold long, at array<long>, x binary, y binary, train binary")
    means = rows.filter("train").groupBy("series_id", "fold").agg(F.avg("y").alias("mean"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                x = np.frombuffer(r.x).reshape(len(r.at), -1)
                codes = np.stack([np.searchsorted(np.asarray(e, float), c, "left").astype(np.uint8) for e, c in zip(r.edges, x.T)], 1)
                yield pd.DataFrame({"series_id": [r.series_id], "fold": [r.fold], "at": [r.at], "codes": [codes.tobytes()], "y": [r.y], "train": [r.train], "fit": [np.full(len(r.at), r.mean).tobytes()]})

    return packed.join(edges.join(means, ["series_id", "fold"]), ["series_id", "fold"]).mapInPandas(encode, _STATE)


def _nodes(codes: np.ndarray, feature: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The node of each row below the levels of a tree in heap order."""
    node, begin = np.zeros(len(codes), np.int64), 0
    while begin < len(feature):
        at = begin + node
        node = 2 * node + (codes[np.arange(len(codes)), feature[at]] > edge[at])
        begin = 2 * begin + 1
    return node


def _histograms(state: DataFrame, trees: DataFrame, width: int) -> DataFrame:
    """(series_id, fold, cell, g, n): gradients and rows summed by cell, (node x features + feature) x 256 + bin, below the levels so far."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                train = np.frombuffer(r.train, np.uint8) > 0
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(r.at), width)[train]
                gradient = (np.frombuffer(r.fit) - np.frombuffer(r.y))[train]
                node = _nodes(codes, np.asarray(r.feature, int), np.asarray(r.edge, int))
                cells = ((node[:, None] * width + np.arange(width)) * 256 + codes).ravel()
                n = np.bincount(cells)
                g = np.bincount(cells, np.repeat(gradient, width))
                here = np.flatnonzero(n)
                yield pd.DataFrame({"series_id": r.series_id, "fold": r.fold, "cell": here, "g": g[here], "n": n[here]})

    joined = state.select("series_id", "fold", "at", "codes", "y", "train", "fit").join(trees.select("series_id", "fold", "feature", "edge"), ["series_id", "fold"])
    return joined.mapInPandas(sums, "series_id string, fold long, cell long, g double, n long").groupBy("series_id", "fold", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _grown(histograms: DataFrame, trees: DataFrame, level: int, width: int, rate: float, l2: float, least: int) -> DataFrame:
    """The trees with their next level; ``step`` is what a row of each node below it adds to the fit."""

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = 1 << level
        gs, hs = np.zeros(m * width * 256), np.zeros(m * width * 256)
        gs[pdf["cell"]], hs[pdf["cell"]] = pdf["g"], pdf["n"]
        gs, hs = (a.reshape(m, width, 256).cumsum(2) for a in (gs, hs))
        g, h = gs[:, :1, -1:], hs[:, :1, -1:]
        gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g * g / (h + l2)
        gain[(hs < least) | (h - hs < least)] = -np.inf
        best = gain.reshape(m, -1).argmax(1)
        feature, edge = np.divmod(best, 256)
        splits = gain.reshape(m, -1)[np.arange(m), best] > 1e-12
        left = [np.where(splits, a[np.arange(m), feature, edge], a[:, 0, -1]) for a in (gs, hs)]
        whole = [a[:, 0, -1] for a in (gs, hs)]
        below_g, below_h = (np.stack([a, w - a], 1).ravel() for a, w in zip(left, whole))
        return pd.DataFrame({"series_id": [key[0]], "fold": [key[1]], "more_feature": [feature], "more_edge": [np.where(splits, edge, NOWHERE)], "step": [-rate * below_g / (below_h + l2)]})

    new = histograms.groupBy("series_id", "fold").applyInPandas(split, "series_id string, fold long, more_feature array<int>, more_edge array<int>, step array<double>")
    return trees.select("series_id", "fold", "feature", "edge").join(new, ["series_id", "fold"]).select("series_id", "fold", F.concat("feature", "more_feature").alias("feature"), F.concat("edge", "more_edge").alias("edge"), "step")


def _advanced(state: DataFrame, trees: DataFrame, width: int) -> DataFrame:
    """The chunks with a tree added to their fit."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fits = []
            for r in pdf.itertuples():
                node = _nodes(np.frombuffer(r.codes, np.uint8).reshape(len(r.at), width), np.asarray(r.feature, int), np.asarray(r.edge, int))
                fits.append((np.frombuffer(r.fit) + np.asarray(r.step)[node]).tobytes())
            yield pdf.drop(columns=["feature", "edge", "step"]).assign(fit=fits)

    names = [c.split()[0] for c in _STATE.split(", ")]
    return state.join(trees, ["series_id", "fold"]).select(*names, "feature", "edge", "step").mapInPandas(add, _STATE)


def boost_by_levels(matrix: DataFrame, config: WalkForwardConfig, model: str = "gradient_boosting", target: str = TARGET, *, rounds: int = 100, depth: int = 3, rate: float = 0.05, l2: float = 0.5, bins: int = 255, least: int = 20) -> DataFrame:
    """Predictions of ``learners.boosting`` fitted by Spark jobs, ``depth`` for each round and one that writes the fits.

    A row lies in a chunk of each fold that trains or tests it, as bytes. Where a feature has more than ``bins`` values its edges are sketched
    quantiles, so trees then differ a little from those of a local fit.
    """
    scratch = Scratch(matrix.sparkSession, "boosting")
    features = feature_names(matrix, target)
    width = len(features)
    plain = [f"x{i}" for i in range(width)]
    rows = matrix.select("series_id", "row_idx", *(F.col(c).cast("double").alias(p) for c, p in zip(features, plain)), F.col(target).cast("double").alias("y"))
    train = trained_folds(rows, config).filter("first <= last").withColumns({"fold": F.explode(F.sequence("first", "last")), "train": F.lit(True)}).drop("first", "last")
    tested = rows.withColumns({"fold": fold_of(F.col("row_idx"), config), "train": F.lit(False)}).filter("fold IS NOT NULL")
    edges = scratch.write(fold_edges(train, plain, bins), "edges")
    state = scratch.write(_chunks(train.unionByName(tested), edges, plain), "state0")
    none = F.array().cast("array<int>")
    root = edges.select("series_id", "fold", none.alias("feature"), none.alias("edge"))
    for r in range(rounds):
        trees = root
        for level in range(depth):
            trees = scratch.write(_grown(_histograms(state, trees, width), trees, level, width, rate, l2, least), f"trees{r}-{level}")
        before, state = f"state{r}", scratch.write(_advanced(state, trees, width), f"state{r + 1}")
        scratch.drop(before, *(f"trees{r}-{level}" for level in range(depth)))

    def fits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                new = np.frombuffer(r.train, np.uint8) == 0
                yield pd.DataFrame({"series_id": r.series_id, "fold": r.fold, "row_idx": np.asarray(r.at)[new], "prediction": np.frombuffer(r.fit)[new]})

    predicted = state.select("series_id", "fold", "at", "train", "fit").mapInPandas(fits, "series_id string, fold long, row_idx long, prediction double")
    shown = matrix.select("series_id", "ts", "row_idx", F.col(target).cast("double").alias("actual"))
    return predicted.join(shown, ["series_id", "row_idx"]).select("series_id", "ts", "row_idx", "fold", F.lit(model).alias("model"), "actual", "prediction")


def predict_boosting(matrix: DataFrame, config: WalkForwardConfig, model: str = "gradient_boosting", target: str = TARGET, *, local_rows: int = LOCAL_ROWS, **how) -> DataFrame:
    """Boosting of each series: in tasks of whole histories up to ``local_rows`` rows, by levels beyond. ``how`` goes to either fit."""
    sizes = matrix.groupBy("series_id").agg(F.count("*").alias("n"))
    long = sizes.filter(F.col("n") > local_rows).select("series_id")
    some = sizes.agg(F.count_if(F.col("n") > local_rows), F.count_if(F.col("n") <= local_rows)).first()
    parts = []
    if some[0]:
        parts.append(boost_by_levels(matrix.join(long, "series_id", "left_semi"), config, model, target, **how))
    if some[1] or not parts:
        parts.append(predict_learned(matrix.join(long, "series_id", "left_anti") if some[0] else matrix, config, model, boosting(**how), target))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
