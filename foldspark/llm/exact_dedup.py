"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over the start of the normalised text, its 64-bit hash and a salt, and
sorted externally by the same key and then the whole normalised text, so equal texts are neighbours; a window keyed by
the whole text compares neighbours in full. Only splitters of bounded length are sampled, never whole texts.

A text with many copies would fill one range. Its hash is found beforehand by counting hashes; its rows are salted
into subgroups of about ``HOT_ROWS`` rows, and one row of each subgroup is compared in full again afterwards: by an
aggregation keyed by the whole text, of which each task sends one row, so no task gets all subgroups of a text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, partitions

HOT_ROWS = 256
#: The list of hot hashes is broadcast; it has at most so many rows whatever the input, since a hot text has at least
#: rows / HOT_TEXTS copies.
HOT_TEXTS = 100_000
#: Rows of merged subgroups that are broadcast.
BROADCAST_TEXTS = HOT_TEXTS
PREFIX = 32


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty. lower() does the same on plain ASCII and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _subgroups(docs: DataFrame, keep: str, payload: bool) -> DataFrame:
    """A row for each document: its subgroup (named by the doc_id that would stay), its size, and what later steps need."""
    rows = docs.count()
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if payload else []))
    # Texts equal after lower-casing A-Z are equal after lower(), so its hash and start never part equal texts.
    loose = F.lower(F.coalesce(F.col("body"), F.lit("")))
    keyed = base.withColumns({"hash": F.xxhash64(loose), "start": F.substring(loose, 1, PREFIX)})
    hot = keyed.groupBy("hash").agg(F.count("*").alias("copies")).filter(F.col("copies") >= max(HOT_ROWS, rows // HOT_TEXTS))
    parts = F.ceil(F.col("copies") / HOT_ROWS).cast("int")
    salted = keyed.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.when(F.col("copies").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.coalesce("id", F.monotonically_increasing_id()), F.lit(1)), parts).cast("int"))).drop("copies")
    ranged = salted.repartitionByRange(partitions(docs.sparkSession), "start", "hash", "salt").withColumn("norm", normalised(F.col("body"))).drop("body")
    group = Window.partitionBy("start", "hash", "salt", "norm")
    order = group.orderBy(F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last())
    return ranged.withColumns({"place": F.row_number().over(order), "sub_id": F.first("id").over(order), "sub_size": F.count(F.lit(1)).over(group)})


def mark_duplicates(docs: DataFrame, keep: str = "largest", payload: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row; with payload also ``row``, kept rows' own columns.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty. The row with the largest (or
    smallest) doc_id of a group stays, a null doc_id last of all; of rows that share that doc_id one stays. An empty
    table gives no rows; extra columns are ignored, or carried in ``row``.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    subs = _subgroups(docs, keep, payload)
    first = F.col("place") == 1
    columns = ["id", "sub_id", "sub_size", "place", "salt", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.when(first & (F.col("salt") >= 0), F.col("norm")).alias("again"), "hash"]
    if payload:  # only the first of a subgroup can stay
        columns.append(F.when(first, F.col("row")).alias("row"))
    subs = scratch.write(subs.select(*columns), "subgroups")
    # The subgroups of hot texts: one row of each, compared in full.
    best = F.max(F.struct("sub_id", F.negate("salt").alias("salt"))) if keep == "largest" else F.min(F.struct(F.col("sub_id").isNull().alias("none"), "sub_id", F.negate("salt").alias("salt")))
    merged = subs.filter(F.col("again").isNotNull()).groupBy("hash", "again").agg(F.first("sha").alias("m_sha"), best.alias("best"), F.sum("sub_size").alias("m_size"))
    merged = merged.select(F.col("hash").alias("m_hash"), "m_sha", F.col("best.sub_id").alias("m_id"), F.negate("best.salt").alias("m_salt"), "m_size")
    merged = scratch.write(merged, "merged")
    same = (F.col("hash") == F.col("m_hash")) & (F.col("sha") == F.col("m_sha"))
    if merged.count() <= BROADCAST_TEXTS:  # small, as hot texts are few: no row of a hot text is moved
        joined = subs.join(F.broadcast(merged), same, "left")
    else:  # texts that differ in letters beyond A-Z share a hash, so there can be more: then by subgroup
        groups = subs.filter(F.col("again").isNotNull()).select("hash", "sha", "salt").join(merged, same).select("m_hash", "m_sha", F.col("salt").alias("g_salt"), "m_id", "m_salt", "m_size")
        joined = subs.join(groups, same & (F.col("salt") == F.col("g_salt")), "left")
    hot = F.col("m_hash").isNotNull()
    out = [
        F.col("id").alias("doc_id"),
        F.when(hot, F.col("m_id")).otherwise(F.col("sub_id")).alias("keep_id"),
        F.when(hot, F.col("m_size")).otherwise(F.col("sub_size")).alias("group_size"),
        (first & F.coalesce(F.col("m_salt") == F.col("salt"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ]
    return joined.select(*out, *(["row"] if payload else []))


def drop_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Null text counts as empty text; of rows that share doc_id and text one stays; an empty table stays empty. See ``mark_duplicates``.
    """
    return mark_duplicates(docs, keep, payload=True).filter("kept").select("row.*")


#: The same rows in DuckDB.
ORACLE_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
