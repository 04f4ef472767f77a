"""Exact order statistics of large groups, without sorting them.

A pass brackets the wanted rank of each group between two of its quantiles, found by Spark's mergeable sketch, and counts exactly what
lies below, at and between them. So a pass leaves less than a hundredth of a group, or ends it; few are needed, and the last
few rows of each group are sorted. All groups go through a pass together; only the size of the largest reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a group that are sorted, and quantiles of a pass.
SORTED, GRID = 4096, 1000


def kth_smallest(rows: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], most: int = SORTED) -> DataFrame:
    """(keys, n, rank, value) of each group: its n values' ``rank(n)``-th smallest, the greatest where the rank is beyond n.

    Values are compared as doubles; nulls are no values, so a group of nulls alone has no row. NaN is above all numbers. ``most`` is the size up to
    which a group is sorted.
    """
    scratch = Scratch(rows.sparkSession, "selection")
    rows = scratch.write(rows.select(*keys, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL"), "rows")
    n = F.count("*")
    none = F.lit(None).cast("double")
    state = rows.groupBy(*keys).agg(n.alias("n")).select(*keys, "n", F.least("n", F.greatest(F.lit(1), rank(F.col("n")))).cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("low"), none.alias("high"), none.alias("found"))
    for k in range(10_000):  # each pass leaves fewer values
        state = scratch.write(state, f"state{k}")
        largest = state.filter("found IS NULL").agg(F.max("inside")).first()[0]
        if largest is None or largest <= most:
            break
        state = _narrowed(_inside(rows, state.filter(F.col("inside") > most), keys), state, keys)
    rest = _inside(rows, state, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("x"))  # at most ``most`` rows of a group
    sorted_ = rest.withColumn("place", place).filter(F.col("place") == F.col("rank") - F.col("below")).select(*keys, "n", "rank", F.col("x").alias(value))
    return sorted_.unionByName(state.filter("found IS NOT NULL").select(*keys, "n", "rank", F.col("found").alias(value)))


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows strictly within their group's bracket, of groups that are not done."""
    df = rows.join(state.filter("found IS NULL"), keys)
    return df.filter((F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high"))))


def _narrowed(inside: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The state after a pass over the rows of the groups that are too large."""
    edges = inside.groupBy(*keys).agg(F.percentile_approx("x", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("edges"))
    at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * GRID)
    edge = lambda shift: F.element_at("edges", (F.greatest(F.lit(0), F.least(F.lit(GRID), at + shift)) + 1).cast("int"))
    bounds = state.join(edges, keys).select(*keys, edge(-2).alias("a"), edge(3).alias("b"))
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    counts = inside.join(bounds, keys).groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), *(F.count_if(c).alias(name) for name, c in (("lt_a", x < a), ("eq_a", x == a), ("lt_b", x < b), ("eq_b", x == b))))
    df = state.join(counts, keys, "left")
    r = F.col("rank") - F.col("below")
    le_a, le_b = F.col("lt_a") + F.col("eq_a"), F.col("lt_b") + F.col("eq_b")
    # The five places where the rank can be, from the left; groups not in this pass stay.
    cases = [
        (F.col("a").isNull(), {}),
        (r <= F.col("lt_a"), {"high": a, "inside": F.col("lt_a")}),
        (r <= le_a, {"found": a}),
        (r <= F.col("lt_b"), {"low": a, "high": b, "below": F.col("below") + le_a, "inside": F.col("lt_b") - le_a}),
        (r <= le_b, {"found": b}),
        (F.lit(True), {"low": b, "below": F.col("below") + le_b, "inside": F.col("inside") - le_b}),
    ]

    def pick(name: str) -> Column:
        out = F.when(cases[0][0], cases[0][1].get(name, F.col(name)))
        for when, values in cases[1:]:
            out = out.when(when, values.get(name, F.col(name)))
        return out.alias(name)

    return df.select(*keys, "n", "rank", *(pick(c) for c in ("below", "inside", "low", "high", "found")))
