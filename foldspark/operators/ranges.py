"""One long series on many tasks: rows numbered in order, cut into ranges, each with the rows around it that it needs.

Numbers come from counts of the ranges of a sorted table, so no window runs over a whole series. A range is a run of
``size`` numbers; a row goes to its own range, and as halo to each range that looks at it from behind or ahead. Windows over (series, range) then
see what windows over the series would, for every row but the halo's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, partitions

#: Rows of a range.
RANGE_ROWS = 1 << 16
_POSITION = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with its rows numbered from 0 in the order of columns that are unique together.

    The table is range-partitioned, sorted and written; its partitions' row counts, added up, number the rows.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = Scratch(spark, "numbered").write(sorted_.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit(_POSITION))}), "rows")
    # One row for each partition: as many as the session has, whatever the table's size.
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_halo(df: DataFrame, number: str, before: int, after: int = 0, size: int = RANGE_ROWS) -> DataFrame:
    """Rows with their ``range``, and copies (``halo`` true) for the ranges whose rows look at them, from up to ``before`` rows later or ``after`` earlier."""
    n = F.col(number)
    first = F.greatest(F.lit(0).cast("long"), F.floor((n - after) / F.lit(size)))
    own = F.floor(n / F.lit(size))
    return df.withColumn("range", F.explode(F.sequence(first, F.floor((n + before) / F.lit(size))))).withColumn("halo", F.col("range") != own)


def before_range(totals: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """(keys, range, columns) of one row for each range: aggregates over the ranges of the same keys before it.

    columns: aggregates of totals' columns. Null for a first range.
    """
    w = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "range", *(c.over(w).alias(name) for name, c in columns.items()))


__all__ = ["RANGE_ROWS", "before_range", "numbered", "with_halo"]
