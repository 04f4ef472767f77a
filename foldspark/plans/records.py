"""Prediction records: one for each tested row, as sorted JSON lines written by tasks, and into a document line by line."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import partitions

LISTING = "_listing"


def prediction_records(rows: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, row_idx, timestamp, actual, a column for each model) of prediction rows in long form."""
    each = (F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in models)
    return rows.groupBy("series_id", "row_idx").agg(F.min("ts").cast("string").alias("timestamp"), F.first("actual").alias("actual"), *each)


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """Writes records as JSON lines in order of series and row; the listing of its files, written last, commits them.

    Each task writes a range of the order, so no record goes through the driver. Returns the listing: (file, records, series_id, first, last)
    in order, where series_id and first are of a file's first record and last is its last one's row.
    """
    spark = records.sparkSession
    order = ["series_id", "row_idx"]
    records.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).write.json(f"{folder}/records")
    written = spark.read.schema(records.schema).json(f"{folder}/records")
    key = F.struct(*order)
    files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("records"), F.min(key).alias("from"), F.max(key).alias("to"))
    listing = files.select("file", "records", "from.series_id", F.col("from.row_idx").alias("first"), F.col("to.row_idx").alias("last")).coalesce(1).sortWithinPartitions("series_id", "first")
    listing.write.json(f"{folder}/{LISTING}")
    return read_listing(spark, folder)


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, records long, series_id string, first long, last long").json(f"{folder}/{LISTING}")


def read_records(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The records that a listing names; a folder without one was not committed, and can't be read."""
    names = [f"{folder}/records/{r['file']}" for r in read_listing(spark, folder).collect()]  # one for each task that wrote
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def in_order(records: DataFrame) -> Iterator[dict]:
    """Records one by one in order; the driver holds one partition of them at a time."""
    for r in records.orderBy("series_id", "row_idx").toLocalIterator():
        yield {k: v for k, v in r.asDict().items() if k not in ("series_id", "row_idx")}


def write_document(path, document: dict, name: str, items: Iterable[dict]) -> Path:
    """A JSON document with a list of items under a name, written item by item."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    head = json.dumps({k: v for k, v in document.items() if k != name}, indent=2, default=str)
    with path.open("w", encoding="utf-8") as f:
        f.write(head[:-1].rstrip() + ("," if len(document.keys() - {name}) else "") + f"\n  {json.dumps(name)}: [")
        for i, item in enumerate(items):
            f.write(("," if i else "") + "\n    " + json.dumps(item, default=str))
        f.write("\n  ]\n}")
    return path
