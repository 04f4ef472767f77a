"""Exact top-k by inner product, term at a time.

Vectors are turned to integers. Queries and candidates are dealt to blocks; a block of candidates is turned to
postings, one list of (candidate, weight) for each dimension. A block of queries goes through the dimensions in which
it has weight and scatters query weight times posting weight into a dense array of scores; the best of each query are
taken by partition selection, and the blocks' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch
from ._vectors import integer_vectors

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def block_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer matrices, one dimension at a time over postings."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for d in range(queries.shape[1]):
        asking = np.flatnonzero(queries[:, d])
        posted = np.flatnonzero(candidates[:, d])
        if not len(asking) or not len(posted):
            continue
        weight, postings = queries[asking, d], candidates[posted, d]
        if len(posted) == len(candidates):
            for q, w in zip(asking, weight):
                scores[q] += w * postings
        else:
            for q, w in zip(asking, weight):
                scores[q, posted] += w * postings
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        scores_of = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        scores_of = np.arange(len(scores))
    return scores_of[np.lexsort((ids[scores_of], -scores[scores_of]))]


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; all of them if there are fewer.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all other rows. Rows that repeat a vec_id are
    rows each: as queries each has its own k best, and the others with its vec_id are candidates. Vectors of different
    length are compared as if filled with zeros; rows without an id, vectors null or with a component null or not finite take no
    part; too long ones are an error (``integer_vectors``). An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors.select("vec_id", "embedding"), scale).filter("id IS NOT NULL")
    rows = Scratch(spark, "exact-topk").write(kept.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so a row keeps its number
    n, queries = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    block = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
    # A query meets every block of candidates: stated queries against all rows, block by block.
    asked = rows.filter(F.col("id") % every == 0).withColumn("q", block(q_blocks, 1)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).select("c", "q", "row", "id", "v")
    given = rows.withColumn("c", block(c_blocks, 0)).select("c", F.lit(-1).alias("q"), "row", "id", "v")
    together = given.unionByName(asked).repartition(max(c_blocks, 1), "c").sortWithinPartitions("c", "q", "id")

    def score(batches):
        state: dict = {"c": None, "q": None, "rows": ([], [], []), "base": None}

        def close():
            numbers, ids, lists = state["rows"]
            state["rows"] = ([], [], [])
            if state["q"] == -1:
                state["base"] = (np.array(numbers, np.int64), np.array(ids, np.int64), lists)
                return None
            if state["q"] is None or state["base"] is None:
                return None
            base_rows, base_ids, base = state["base"]
            width = max(map(len, base + lists), default=0)
            scores = block_scores(_matrix(lists, width), _matrix(base, width))
            out: tuple = ([], [], [], [])
            for i, query in enumerate(numbers):
                other = np.flatnonzero(base_rows != query)
                best = other[_best(scores[i][other], base_ids[other], k)]
                for column, values in zip(out, ([query] * len(best), [ids[i]] * len(best), base_ids[best].tolist(), scores[i][best].tolist())):
                    column.extend(values)
            return pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("row", "query_id", "vec_id", "score"), out)})

        for batch in batches:
            lists = batch.column(4)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (c, q, row, name) in enumerate(zip(*(col.to_pylist() for col in batch.columns[:4]))):
                v = values[ends[i] : ends[i + 1]].copy()
                if (c, q) != (state["c"], state["q"]):
                    if (done := close()) is not None:
                        yield done
                    if c != state["c"]:
                        state["base"] = None
                    state["c"], state["q"] = c, q
                for column, value in zip(state["rows"], (row, name, v)):
                    column.append(value)
        if (done := close()) is not None:
            yield done

    found = together.mapInArrow(score, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB.
ORACLE_SQL = """
WITH r AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM r q JOIN r c ON c.row <> q.row WHERE q.vec_id % 50 = 0),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""
