"""Joins with one row for each key, where some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a key is told is broadcast where it has at least so many rows, and at least a share 1 / HOT_KEYS of all.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def told(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table, which has one row for each key and, as n, how many rows have it; total: of all rows.

    What a hot key is told is broadcast, so its rows stay where they are and no task gets all of them. Keys of so many rows are at most
    ``HOT_KEYS``, whatever the input; the others are joined by key.
    """
    hot = F.col("n") >= max(HOT_ROWS, -(-total // HOT_KEYS))
    found = rows.join(F.broadcast(table.filter(hot).withColumn("_hot", F.lit(True))), key, "left")
    near = found.filter(F.col("_hot")).drop("n", "_hot")
    return near.unionByName(found.filter(F.col("_hot").isNull()).select(*rows.columns).join(table.filter(~hot).drop("n"), key))
