"""Order statistics by selection against sorting, with ties, heavy tails, groups of all sizes and many passes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators.conformal import SplitConformalCalibrator, conformal_radius, split_segments
from foldspark.operators.selection import kth_smallest


def groups(spark, values):
    rows = [(k, None if x is None else float(x)) for k, xs in values.items() for x in xs]
    return spark.createDataFrame(rows, "g string, x double")


@pytest.mark.parametrize("share", [0.0, 0.37, 0.9, 2.0])
def test_kth_smallest(spark, share):
    rng = np.random.default_rng(0)
    values = {
        "normal": rng.normal(size=6000),
        "tail": np.exp(rng.normal(size=5000) * 60),
        "equal": np.full(3000, 2.5),
        "two": rng.integers(0, 2, 4000),
        "few": [3, 1, 2],
        "one": [7],
        "sorted": np.arange(5000),
        "nulls": [None, 4, None, 1],
        "infinite": [math.inf, -math.inf, 0.0] * 400,
    }
    got = {r["g"]: (r["n"], r["rank"], r["x"]) for r in kth_smallest(groups(spark, values | {"none": [None]}), ["g"], "x", lambda n: F.ceil(n * F.lit(share)), 50).collect()}
    want = {}
    for g, xs in values.items():
        xs = sorted(float(x) for x in xs if x is not None)
        rank = min(len(xs), max(1, math.ceil(len(xs) * share)))
        want[g] = (len(xs), rank, xs[rank - 1])
    assert got == want


def test_no_window_over_a_large_group(spark):
    """What is sorted is what the passes leave."""
    rows = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    found = kth_smallest(rows, ["g"], "x", lambda n: F.lit(9000), 100)
    assert found.first()["x"] == sorted(i * 7919 % 20_011 for i in range(20_000))[8999]


def test_radius_and_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(s, m, int(i) * 2 + 5, float(a), float(p)) for s, n in (("a", 300), ("b", 1), ("c", 4)) for m in ("m", "k") for i, (a, p) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "series_id string, model string, row_idx long, actual double, prediction double")
    split = {(r["series_id"], r["model"], r["row_idx"]): r["calibrates"] for r in split_segments(df).collect()}
    assert len(split) == len(rows)
    for r in conformal_radius(df, 0.8).collect():
        mine = sorted(abs(a - p) for s, m, _, a, p in rows if (s, m) == (r["series_id"], r["model"]))
        assert (r["calibration_size"], r["radius"]) == (len(mine), mine[min(len(mine), math.ceil((len(mine) + 1) * 0.8)) - 1])
    for s, n in (("a", 300), ("b", 1), ("c", 4)):
        assert sum(split[s, "m", 2 * i + 5] for i in range(n)) == min(n, max(2, int(0.4 * n)))
    fitted = SplitConformalCalibrator(0.5).fit(df.filter("series_id = 'a'"))
    assert fitted.size == 600 and fitted.radius == sorted(abs(a - p) for s, _, _, a, p in rows if s == "a")[math.ceil(601 * 0.5) - 1]
