"""Exact k-means by Exponion search over blocks of integer vectors.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to any other. Bounds move
with the centroids. A vector whose upper bound lies below the lower one, or below half the distance from its centroid
to the next, keeps its centroid unseen; any other is compared with the centroids in a ball around its own one, taken from the
sorted list of its distances to all others. The radius is inclusive and bounds are widened by the rounding of floats, so
equal distances are always seen; decisions are made on integer squared distances.

A round reads the table of blocks that the round before wrote (vectors, assignment, bounds) and writes the next, each
block with the sums of its clusters: so a lost executor costs its tasks of one round, and only clusters x components sums
reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from ._vectors import integer_vectors

#: Vectors in a block.
BLOCK = 4096
#: Relative width of bounds; far more than the rounding of a square root and a few sums.
WIDEN = 1e-12
_BLOCKS = "ids array<long>, vectors binary, cluster array<int>, upper array<double>, lower array<double>, touched array<int>, counts array<long>, inertias array<long>, sums array<long>"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("cluster", pa.list_(pa.int32())), ("upper", pa.list_(pa.float64())), ("lower", pa.list_(pa.float64())), ("touched", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("inertias", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, as integers."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Integer centroids with each one's distances to the others in ascending order, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        apart = np.sqrt(np.stack([squared(at, c) for c in at]).astype(float))
        np.fill_diagonal(apart, -1)
        self.order = apart.argsort(1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.next = self.apart[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = np.sqrt(squared(at, before).astype(float)) * (1 + WIDEN) if before is not None else np.zeros(k)
        top = np.sort(self.moved)[::-1]
        self.others_moved = np.where(self.moved == top[0], top[1], top[0]) if k > 1 and (self.moved == top[0]).sum() == 1 else np.full(k, top[0])

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower of vectors without bounds."""
        best, second, cluster = np.full(len(x), 2**62), np.full(len(x), 2**62), np.zeros(len(x), np.int32)
        for j, c in enumerate(self.at):
            d = squared(x, c)
            closer = d < best
            second = np.where(closer, best, np.minimum(second, d))
            best, cluster = np.where(closer, d, best), np.where(closer, np.int32(j), cluster)
        return cluster, np.sqrt(best) * (1 + WIDEN), np.sqrt(second) * (1 - WIDEN)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper and lower after the centroids have moved, and how many distances that took."""
        cluster = cluster.copy()
        upper = (upper + self.moved[cluster]) * (1 + WIDEN)
        lower = lower - self.others_moved[cluster] - WIDEN * (lower + self.others_moved[cluster])
        safe = np.maximum(lower, self.next[cluster] / 2 * (1 - WIDEN))
        rows = np.flatnonzero(upper >= safe)
        own = squared(x[rows], self.at[cluster[rows]])
        seen = len(rows)
        upper[rows] = np.sqrt(own) * (1 + WIDEN)
        again = upper[rows] >= safe[rows]
        rows, own = rows[again], own[again]
        before = cluster[rows]
        for a in np.unique(before).tolist():
            mine = before == a
            at, best = rows[mine], own[mine]
            number, second = np.full(len(at), a, np.int32), np.full(len(at), 2**62)
            inside = np.searchsorted(self.apart[a], (2 * upper[at] + self.next[a]) * (1 + WIDEN), "right")
            for t in range(int(inside.max(initial=0))):
                some = np.flatnonzero(inside > t)
                j = self.order[a, t]
                d = squared(x[at[some]], self.at[j])
                seen += len(some)
                closer = (d < best[some]) | (d == best[some]) & (j < number[some])
                second[some] = np.where(closer, best[some], np.minimum(second[some], d))
                best[some], number[some] = np.where(closer, d, best[some]), np.where(closer, np.int32(j), number[some])
            cluster[at], upper[at], lower[at] = number, np.sqrt(best) * (1 + WIDEN), np.sqrt(second) * (1 - WIDEN)
        return cluster, upper, lower, seen


def _row(ids: list, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> pa.RecordBatch:
    """A block with the counts, inertias and sums of its clusters."""
    order = np.argsort(cluster, kind="stable")
    touched, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
    inertias = np.add.reduceat(squared(x, centroids.at[cluster])[order], starts)
    sums = np.add.reduceat(x[order], starts, axis=0)
    values = [ids, x.astype("<i4").tobytes(), cluster, upper, lower, touched, counts, inertias, sums.ravel()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)


def first_blocks(rows: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    """Blocks of (id, v) rows, each vector compared with all centroids."""

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield _row(part.column(0).to_pylist(), x, *centroids.scan(x), centroids)

    return rows.select("id", "v").mapInArrow(pack, _BLOCKS)


def next_blocks(blocks: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    """The blocks after the centroids have moved."""

    def assign(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, data, *state = (batch.column(i)[r] for i in range(5))
                x = np.frombuffer(data.as_py(), "<i4").reshape(-1, width).astype(np.int64)
                cluster, upper, lower, _ = centroids.assign(x, *(s.values.to_numpy() for s in state))
                yield _row(ids.as_py(), x, cluster, upper, lower, centroids)

    return blocks.select("ids", "vectors", "cluster", "upper", "lower").mapInArrow(assign, _BLOCKS)


def _moved(blocks: DataFrame, at: np.ndarray) -> np.ndarray:
    """Centroids of the blocks' clusters, rounded down; those of no vector stay. Clusters x components rows reach the driver."""
    width = at.shape[1]
    each = blocks.select("counts", "sums", F.posexplode("touched").alias("t", "cluster"))
    each = each.select("cluster", F.element_at("counts", F.col("t") + 1).alias("n"), F.posexplode(F.slice("sums", F.col("t") * width + 1, width)).alias("i", "x"))
    wide = "decimal(38,0)"
    new = [list(map(int, c)) for c in at]
    for cluster, i, x, n in each.groupBy("cluster", "i").agg(F.sum(F.col("x").cast(wide)).alias("x"), F.sum(F.col("n").cast(wide)).alias("n")).collect():
        new[cluster][i] = int(x) // int(n)
    return np.array(new, np.int64)


@dataclass
class Clustering:
    """``rows``: (vec_id, cluster, distance) of each vector, distance squared; ``blocks``: the table behind them; final ``centroids``."""

    rows: DataFrame
    blocks: DataFrame
    centroids: np.ndarray


def exponion(vectors: DataFrame, width: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> Clustering:
    """k-means on floor(scale * x) of the vectors with ``width`` components, none null or not finite; others are left out.

    Centroids start as the vectors with the least sha256 of salt and vec_id (ties by the vector; null ids last); fewer vectors
    than ``clusters`` start as many as there are. Each round assigns every vector to the nearest centroid, the smaller number on
    ties, and replaces a centroid by its vectors' mean, rounded down; without vectors it stays. A last assignment follows.
    When no centroid moves, the rounds left would change nothing and are not run. Repeated rows and ids are vectors each;
    an empty table has no clusters. A task holds clusters x clusters distances.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "exponion")
    kept = integer_vectors(vectors.filter(F.size("embedding") == width), scale)
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    starts = kept.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).collect()
    if not starts:
        empty = spark.createDataFrame([], "vec_id long, cluster int, distance long")
        return Clustering(empty, spark.createDataFrame([], _BLOCKS), np.zeros((0, width), np.int64))
    now = Centroids(np.array([r["v"] for r in starts], np.int64))
    blocks = scratch.write(first_blocks(kept, now, width), "round0")
    for r in range(rounds):
        new = _moved(blocks, now.at)
        if (new == now.at).all():
            break
        now = Centroids(new, now.at)
        before, blocks = f"round{r}", scratch.write(next_blocks(blocks, now, width), f"round{r + 1}")
        scratch.drop(before)

    def measure(batches):
        for batch in batches:
            for ids, data, cluster in zip(*(batch.column(i) for i in range(3))):
                cluster = cluster.values
                x = np.frombuffer(data.as_py(), "<i4").reshape(-1, width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, cluster, pa.array(squared(x, now.at[cluster.to_numpy()]))], ["vec_id", "cluster", "distance"])

    rows = blocks.select("ids", "vectors", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long")
    return Clustering(rows, blocks, now.at)


def cluster_digest(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector. No vectors give no rows."""
    spark = found.rows.sparkSession
    each = found.blocks.select(F.explode(F.arrays_zip("touched", "inertias")).alias("t")).groupBy(F.col("t.touched").alias("cluster")).agg(F.sum("t.inertias").alias("n")).collect()
    inertia = sum(n for _, n in each)
    sha = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    # One row for each cluster: as many as the parameter says.
    about = spark.createDataFrame([(c, n, inertia, sha(found.centroids[c])) for c, n in each], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(width: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> str:
    """The same in DuckDB: rounds one after another."""
    parts = [
        f"""e AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS k, v FROM e QUALIFY k < {clusters})""",
    ]
    for r in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT e.row, min({{'d': {distance}, 'k': c.k}}) AS best FROM e CROSS JOIN c{r} c GROUP BY e.row)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
            SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.best.k AS k, unnest(range({width})) AS i, unnest(e.v) AS x FROM a{r} a JOIN e USING (row)) GROUP BY k, i)
            GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT e.vec_id, CAST(a.best.k AS INTEGER) AS cluster, a.best.d AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN e USING (row) JOIN c{rounds} c ON c.k = a.best.k"""


ORACLE_SQL = _oracle()
