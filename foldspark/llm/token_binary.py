"""Token ids as Simple-8b words: the format, its files, and reading them back.

A block is the ids of one or more whole documents as 64-bit little-endian words. The upper four bits of a word
select how many ids it holds and how wide each is (``SELECTORS``); selector 0 is an escape: the next word is one raw
64-bit value. A row of the file is a block: its shard and number, the position of its first id in the shard, the
numbers of ids of its documents (so the offsets of each document in the decoded block) and the words. Rows are stored
in Parquet by Spark's own writer, so any file system Spark knows serves, and a lost task leaves no partial file.
Shards hold ascending doc_id, and shard numbers ascend with it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import Scratch, partitions

#: Fixed values of the format: ids in a word and bits of each, by selector from 1; selector 0 is the escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK_IDS = 1 << 16
PREFIX = 64
#: Bits of each number that a public vocabulary may have for an id.
_BITS = np.frexp(np.arange(1 << 18, dtype=np.float64))[1].astype(np.uint8)
BLOCK_SCHEMA = "shard int, block int, first_id long, doc_ids array<long>, doc_tokens array<long>, n_ids long, words binary"


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values; each word takes as many of the next values as fit in it."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8")
    need = np.zeros(n + 60, np.uint8)  # bits of each value; behind the end, values of no bits fill the last word
    if ids.max() < len(_BITS):
        need[:n] = _BITS[ids]
    else:
        need[:n] = [int(x).bit_length() for x in ids]
    ids = np.ascontiguousarray(ids, np.uint64)
    selector, width = np.zeros(n, np.uint8), need.copy()
    reach = 1
    for k in range(len(SELECTORS), 0, -1):
        count, bits = SELECTORS[k - 1]
        while reach < count:
            width[: len(width) - reach] = np.maximum(width[: len(width) - reach], need[reach:])
            reach += 1
        fits = width[:n] <= bits
        if not fits.any():
            break
        selector[fits] = k
    # The starts of the words: the chain of jumps from 0, doubled in length each round.
    jump = np.append(np.minimum(np.arange(n) + np.array([1, *(c for c, _ in SELECTORS)])[selector], n), n).astype(np.int32)
    starts = np.zeros(1, np.int32)
    while starts[-1] < n:
        starts = np.concatenate([starts, jump[starts]])
        jump = jump[jump]
    starts = starts[: np.searchsorted(starts, n)]
    kind = selector[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(kind == 0)[:-1]])
    words = np.zeros(len(starts) + int((kind == 0).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for k, (count, bits) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            values = padded[starts[rows][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[rows]] = np.bitwise_or.reduce(values, axis=1) | np.uint64(k << 60)
    words[place[kind == 0] + 1] = ids[starts[kind == 0]]
    return words.astype("<u8")


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of Simple-8b words, all words of a selector at a time."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    if (kind == 0).any():  # a raw value behind an escape may look like any selector
        real, i, kinds = [], 0, kind.tolist()
        while i < len(kinds):
            real.append(i)
            i += 2 if kinds[i] == 0 else 1
        real = np.array(real)
    else:
        real = np.arange(len(words))
    kind = kind[real]
    counts = np.array([1, *(c for c, _ in SELECTORS), 0])[kind]
    begin = np.cumsum(counts) - counts
    out = np.zeros(max(n, int(counts.sum())), np.uint64)
    for k, (count, bits) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            values = words[real[rows]][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[begin[rows][:, None] + np.arange(count)] = values & np.uint64((1 << bits) - 1)
    out[begin[kind == 0]] = words[real[kind == 0] + 1]
    return out[:n]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int) -> None:
    """Encodes (doc_id, text) with a tokenizers file and writes Simple-8b blocks in ascending doc_id order.

    Null text is empty, so a document always has its end id. Null doc_ids come first; rows that share a doc_id follow one
    another in the order of their texts' first ``PREFIX`` characters, then their hashes, so they may lie in several
    shards. A document longer than ``BLOCK_IDS`` is a block of its own. An empty table gives no blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The salt deals out rows that are equal in all: which of them comes first can't be seen.
    keyed = rows.withColumns({"start": F.substring("text", 1, PREFIX), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id() % 1024})
    ordered = keyed.repartitionByRange(shards, "doc_id", "start", "hash", "salt").sortWithinPartitions("doc_id", "start", "hash", "salt").select("doc_id", "text")

    def blocks(batches):
        shard, tokens = TaskContext.get().partitionId(), encoder(tokenizer_path)
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        state = {"block": 0, "first": 0, "ids": 0}
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary())])

        def flush():
            n = state["ids"]
            words = encode_words(np.concatenate(held))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([shard], pa.int32()), pa.array([state["block"]], pa.int32()), pa.array([state["first"]], pa.int64()), one(pa.concat_arrays(names)), one(pa.array(np.concatenate(sizes))), pa.array([n], pa.int64()), pa.array([words.tobytes()], pa.binary())]
            state.update(block=state["block"] + 1, first=state["first"] + n, ids=0)
            for x in (held, names, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for first, last, ids, each in tokens.slices(batch.column(1)):
                ids, each = np.insert(ids, np.cumsum(each), end_id), each + 1
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
                a = 0
                while a < len(each):  # documents up to the one that fills the block
                    b = min(len(each), int(np.searchsorted(ends, ends[a] + BLOCK_IDS - state["ids"])))
                    held.append(ids[ends[a] : ends[b]])
                    names.append(batch.column(0).slice(first + a, b - a))
                    sizes.append(each[a:b])
                    state["ids"] += int(ends[b] - ends[a])
                    if state["ids"] >= BLOCK_IDS:
                        yield flush()
                    a = b
        if held:
            yield flush()

    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def decode_documents(blocks: DataFrame) -> DataFrame:
    """(shard, doc_id, first_id, n_tokens, ids binary) of every document of the blocks; ids as unsigned 32-bit.

    Repeated and null doc_ids are documents each; no blocks give no rows.
    """

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_words(np.frombuffer(r["words"], "<u8"), r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"]] * len(ends), pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()), "first_id": pa.array(r["first_id"] + starts, pa.int64()), "n_tokens": pa.array(r["doc_tokens"], pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})

    return blocks.mapInArrow(documents, "shard int, doc_id long, first_id long, n_tokens long, ids binary")


def read_digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    blocks = read_blocks(spark, path)

    def digest(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = decode_words(np.frombuffer(r["words"], "<u8"), r["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                crc = [zlib.crc32(memoryview(data)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"]] * len(ends), pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()), "first_id": pa.array(r["first_id"] + starts, pa.int64()), "n_tokens": pa.array(r["doc_tokens"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = blocks.mapInArrow(digest, "shard int, doc_id long, first_id long, n_tokens long, ids_crc32 long")
    # One row for each shard: as many as the writer had tasks, whatever the number of documents.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select(F.col("shard"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the documents' ids in the shared folder and returns the digest read back from the files.

    An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = Scratch(spark, "token-binary").path("shards")
    write_tokens(docs, path, tokenizer_path, end_id, partitions(spark))
    return read_digest(spark, path)
