"""Point-in-time features and the next-return label, as window functions.

Observations are rows of (series_id, ts, close[, volume]). A feature at t uses nothing later than t - 1, the label is
the return at t + 1. All windows share one partitioning and order, so Spark sorts once: a partition for each series, which
suits a panel, or for each range of a long series (``range_rows``), with the rows that it looks at before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null, is_finite, ratio
from ..scratch import Scratch
from .ranges import RANGE_ROWS, before_range, numbered, with_halo

LAGS = (1, 2, 3, 5, 10, 20)
SPANS = (5, 10, 20, 60)
VOLUME_SPAN = 20
TARGET = "target_next_return"
KEYS = ("series_id", "ts")
MINIMUM = 63
#: The farthest row that a feature looks back to.
BACK = max(*LAGS, *SPANS) + 1
SERIES = ("series_id",)


def series_window(by=SERIES) -> Window:
    return Window.partitionBy(*by).orderBy("ts")


def _full(x: str, k: int, f, by=SERIES) -> Column:
    """f of x over the k rows before this one, null unless all k are there."""
    w = series_window(by).rowsBetween(-k, -1)
    return F.when(F.count(x).over(w) == k, f(x).over(w))


def with_return(df: DataFrame, by=SERIES) -> DataFrame:
    return df.withColumn("return", ratio(F.col("close"), F.lag("close", 1).over(series_window(by))) - 1)


def lag_returns(lags=LAGS, by=SERIES) -> dict[str, Column]:
    return {f"return_lag_{k}": F.lag("return", k).over(series_window(by)) for k in lags}


def rolling_means(spans=SPANS, by=SERIES) -> dict[str, Column]:
    return {f"mean_{k}": _full("return", k, F.avg, by) for k in spans}


def rolling_vols(spans=SPANS, by=SERIES) -> dict[str, Column]:
    return {f"vol_{k}": _full("return", k, F.stddev_samp, by) for k in spans}


def momenta(spans=SPANS, by=SERIES) -> dict[str, Column]:
    w = series_window(by)
    return {f"momentum_{k}": ratio(F.lag("close", 1).over(w), F.lag("close", k + 1).over(w)) - 1 for k in spans}


def volume_features(span: int = VOLUME_SPAN, by=SERIES) -> dict[str, Column]:
    w = series_window(by)
    last = F.lag("volume", 1).over(w)
    return {
        "volume_change_lag_1": ratio(last, F.lag("volume", 2).over(w)) - 1,
        f"volume_z_{span}": ratio(last - _full("volume", span, F.avg, by), _full("volume", span, F.stddev_samp, by)),
    }


def price_features(by=SERIES) -> dict[str, Column]:
    out = lag_returns(by=by)
    for k in SPANS:
        out |= rolling_means((k,), by) | rolling_vols((k,), by) | momenta((k,), by)
    return out


def feature_columns(volume: bool) -> list[str]:
    names = [f"return_lag_{k}" for k in LAGS] + [f"{n}_{k}" for k in SPANS for n in ("mean", "vol", "momentum")]
    return names + (["volume_change_lag_1", f"volume_z_{VOLUME_SPAN}"] if volume else [])


def target(by=SERIES) -> dict[str, Column]:
    return {TARGET: F.lead("return", 1).over(series_window(by))}


def supervised_matrix(observations: DataFrame, range_rows: int | None = None, volume: bool = True) -> DataFrame:
    """series_id, ts, row_idx, features and label; rows with a null or a value that is not finite are left out.

    Features of the volume are made where there is one, unless ``volume`` is false.

    Lags and windows run over all observations; rows are dropped and numbered (from 0, for each series) afterwards.

    With ``range_rows`` no task holds more than a range of so many observations and the ``BACK`` before it: observations are numbered
    in order, and rows by the counts of the ranges before. The rows are the same; the table is written twice for it. Without,
    a series is one task's.
    """
    volume = volume and "volume" in observations.columns
    by = SERIES
    if range_rows:
        names = [*KEYS, "close", *(["volume"] if volume else [])]
        observations, by = with_halo(numbered(observations.select(*names), list(KEYS)), "number", BACK, 1, range_rows), ("series_id", "range")
    df = with_return(observations, by)
    columns = price_features(by) | (volume_features(by=by) if volume else {}) | target(by)
    df = df.withColumns(columns).filter(~F.col("halo")) if range_rows else df.withColumns(columns)
    df = df.select(*by, "ts", *(finite_or_null(F.col(c)).alias(c) for c in columns)).na.drop("any")
    df = df.withColumn("row_idx", (F.row_number().over(series_window(by)) - 1).cast("long"))
    if range_rows:
        df = Scratch(df.sparkSession, "features").write(df, "rows")
        counts = df.groupBy("series_id", "range").agg(F.count("*").alias("n"))
        before = before_range(counts, ["series_id"], before=F.sum("n"))
        df = df.join(before, ["series_id", "range"]).withColumn("row_idx", F.col("row_idx") + F.coalesce("before", F.lit(0)))
    return df.select(*KEYS, "row_idx", *columns)


def checked_matrix(observations: DataFrame) -> DataFrame:
    """The matrix of checked observations, in ranges where a series is longer than one; errors name what is wrong."""
    from .quality import require_observations

    longest = require_observations(observations)
    out = supervised_matrix(observations, RANGE_ROWS if longest > RANGE_ROWS else None)
    if out.isEmpty():
        raise ValueError(f"at least {MINIMUM} valid price observations are required")
    return out


def with_volume(close: DataFrame, volume: DataFrame) -> DataFrame:
    """Close with the volume of the same series and time, null where there is none; extra volume is left out."""
    return close.join(volume.select(*KEYS, F.col("volume").cast("double")), list(KEYS), "left")


def align_volume(close: DataFrame, volume: DataFrame) -> DataFrame:
    """As ``with_volume``, but an observation without volume is an error."""
    out = with_volume(close, volume)
    if not out.filter(F.col("volume").isNull()).isEmpty():
        raise ValueError("volume must cover every close timestamp")
    return out


FORBIDDEN = ("future_return", "next_close", "target_lag_0")


def assert_no_leakage(df: DataFrame, target_column: str = TARGET, keys=(*KEYS, "row_idx")) -> None:
    """Raises ValueError for a matrix that names the future, lacks label or features, or is not numeric and finite."""
    columns = [c for c in df.columns if c not in keys]
    if named := sorted(set(FORBIDDEN).intersection(columns) - {target_column}):
        raise ValueError(f"forbidden future columns: {named}")
    if target_column not in columns:
        raise ValueError(f"target column is required: {target_column}")
    if len(columns) < 2:
        raise ValueError("at least one feature column is required")
    kinds = dict(df.dtypes)
    if any(kinds[c].split("(")[0] not in ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal") for c in columns):
        raise ValueError("features and target must be numeric")
    row = df.agg(F.count("*").alias("rows"), *(F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    if not row["rows"] or any(row[c] for c in columns):
        raise ValueError("features and target must be finite and non-empty")
