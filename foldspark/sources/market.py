"""Observations from CSV files, checked strictly and in file order; their description and fingerprint."""

from __future__ import annotations

import csv
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..operators.ranges import numbered
from .times import parse_time

#: Hashes joined into one at each level of a fingerprint.
RUN = 4096


@dataclass(frozen=True)
class MarketData:
    """Checked observations (series_id, ts, close[, volume]) of one series, with their name and fingerprint."""

    observations: DataFrame
    source_name: str
    sha256: str

    @property
    def has_volume(self) -> bool:
        return "volume" in self.observations.columns

    def metadata(self) -> dict:
        n, first, last = self.observations.agg(F.count("*"), *(F.date_format(f("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX") for f in (F.min, F.max))).first()
        return {"kind": "external_market_csv", "source_name": self.source_name, "sha256": self.sha256, "raw_observations": n, "start": first, "end": last, "has_volume": self.has_volume}


def canonical_row(df: DataFrame):
    """One observation as text: the time to the microsecond, then the numbers."""
    parts = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.col("close").cast("double").cast("string")]
    return F.concat_ws(",", *parts, *([F.col("volume").cast("double").cast("string")] if "volume" in df.columns else []))


def fingerprint(observations: DataFrame, run: int = RUN) -> DataFrame:
    """(series_id, sha256) of each series: the root of a tree of hashes over its rows in order of time.

    Rows are hashed one by one; then each ``run`` of hashes, joined by line feeds, is hashed again, at least once and until one is left. So no
    task holds more than a run, however long a series is, and a series' fingerprint depends on its own rows alone.
    """
    rows = numbered(observations.withColumn("h", F.sha2(canonical_row(observations).cast("binary"), 256)).select("series_id", "ts", "h"), ["series_id", "ts"])
    first = rows.groupBy("series_id").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    longest = first.agg(F.max("n")).first()[0] or 0
    hashes = rows.join(first, "series_id").select("series_id", (F.col("number") - F.col("first")).alias("i"), "h")
    level = 0
    while level == 0 or longest > 1:
        mine = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        joined = F.sha2(F.array_join(mine, "\n").cast("binary"), 256)
        done = (F.col("run") == 0) & (F.size(mine) == 1)  # one hash is left of this series
        runs = hashes.groupBy("series_id", F.floor(F.col("i") / F.lit(run)).alias("run"))
        hashes = runs.agg((F.when(done, mine[0]).otherwise(joined) if level else joined).alias("h")).withColumnRenamed("run", "i")
        level, longest = level + 1, -(-longest // run)
    return hashes.select("series_id", F.col("h").alias("sha256"))


def _header(spark: SparkSession, path: str) -> list[str]:
    try:
        lines = spark.read.text(path).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ValueError(f"market CSV does not exist: {path}") from e
        raise ValueError(f"cannot read market CSV: {path}") from e
    return next(csv.reader([lines[0][0]]), []) if lines else []


def read_market_csv(spark: SparkSession, path: str, *, timestamp_column: str = "timestamp", close_column: str = "close", volume_column: str | None = "volume", series_id: str = "default") -> MarketData:
    """Reads one series from a CSV file with a header; the first rule that it breaks raises ValueError.

    Rules, in order: the file exists; column names are non-empty and distinct; the file can be read; it has the
    columns, and rows; times can be parsed (``times.parse_time``), are unique and rise in file order; closes are finite and
    positive; volumes are finite and not negative. Order is checked within each split of the file, and over the splits by
    their first and last times, so a long file is read by many tasks.
    """
    path = str(path)
    names = [timestamp_column, close_column, *([volume_column] if volume_column is not None else [])]
    header = _header(spark, path)
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("market CSV column names must be non-empty and distinct")
    if missing := sorted(set(names) - set(header)):
        if header:
            raise ValueError(f"market CSV is missing columns: {missing}")
        raise ValueError("market CSV cannot be empty")
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
    place = [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")]
    parsed = raw.select(*place, parse_time(F.col(f"`{timestamp_column}`")).alias("ts"), *(F.col(f"`{c}`").try_cast("double").alias(n) for c, n in zip(names[1:], ("close", "volume"))))
    rows = parsed.withColumn("before", F.lag("ts").over(Window.partitionBy("split").orderBy("line")))
    close = F.col("close")
    checks = {
        "n": F.count("*"),
        "invalid": F.count_if(F.col("ts").isNull()),
        "falls": F.count_if(F.col("ts") < F.col("before")),
        "stays": F.count_if(F.col("ts") == F.col("before")),
        "close_number": F.count_if(~is_finite(close)),
        "close_sign": F.count_if(close <= 0),
    }
    if volume_column is not None:
        checks |= {"volume_number": F.count_if(~is_finite(F.col("volume"))), "volume_sign": F.count_if(F.col("volume") < 0)}
    # One row for each split of the file.
    splits = rows.groupBy("split").agg(*(c.alias(k) for k, c in checks.items()), F.min_by("ts", "line").alias("first"), F.max_by("ts", "line").alias("last"))
    edge = F.lag("last").over(Window.orderBy("split"))
    splits = splits.withColumns({"edge_falls": (F.col("first") < edge).cast("long"), "edge_stays": (F.col("first") == edge).cast("long")})
    found = splits.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*checks, "edge_falls", "edge_stays"))).first()
    falls = found["falls"] + found["edge_falls"]
    # Times that rise are unique; only where they don't is a repeat looked for among all.
    repeated = found["stays"] + found["edge_stays"] or falls and not found["invalid"] and not parsed.groupBy("ts").count().filter("count > 1").isEmpty()
    rules = [
        (not found["n"], "market CSV cannot be empty"),
        (found["invalid"], "market CSV has invalid timestamps"),
        (repeated, "market CSV timestamps must be unique"),
        (falls, "market CSV timestamps must be increasing"),
        (found["close_number"], f"column {close_column} must hold finite numeric values"),
        (found["close_sign"], f"column {close_column} must be strictly positive"),
    ]
    if volume_column is not None:
        rules += [(found["volume_number"], f"column {volume_column} must hold finite numeric values"), (found["volume_sign"], f"column {volume_column} cannot be negative")]
    for broken, message in rules:
        if broken:
            raise ValueError(message)
    observations = parsed.select(F.lit(series_id).alias("series_id"), "ts", "close", *(["volume"] if volume_column is not None else []))
    return MarketData(observations, path.rstrip("/").rsplit("/", 1)[-1], fingerprint(observations).first()["sha256"])


def read_table(spark: SparkSession, path: str, time: str, close: str, volume: str | None = None, series: str | None = None, form: str = "parquet") -> DataFrame:
    """Observations from any table Spark reads; only the named columns are read."""
    df = spark.read.format(form).load(path)
    columns = [(F.col(series).cast("string") if series else F.lit("default")).alias("series_id"), F.col(time).alias("ts"), F.col(close).cast("double").alias("close")]
    return df.select(*columns, *([F.col(volume).cast("double").alias("volume")] if volume else []))
