"""Hard negatives by inner product, behind an orthogonal PCA rotation.

Vectors are integers. An orthogonal rotation to the principal axes of all rows leaves inner products as they are and moves most of
their size to the leading components. For a tile of anchors and a block of rows the product of the leading
components is one matrix product; what is missing is at most the product of the two remainders' lengths, and a slack
far above any rounding. So every score has bounds; rows that can't be among the best, or within the wanted scores, are
left out after the first components, more after the next, and the scores of the others are integer products.

Anchors and rows meet block by block: a stated query set against all rows. Each row goes to one block, whatever its label, so
no label makes a task larger. The positives are found first; their scores set the windows in which negatives are sought.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, partitions
from ._vectors import integer_vectors

#: Components of a block's vectors; rows of one are as many as fit, and least rows worth a block of their own.
BLOCK_VALUES, LEAST_ROWS = 1 << 22, 1 << 10
#: Rows compared at a time, windows sought at a time, pairs multiplied at a time.
PART, TILE, PAIRS = 1 << 12, 256, 1 << 15
#: Leading components that are rotated; longer vectors keep the others as they are.
ROTATED = 512
#: Where more than one in so many pairs of a tile is left after the first stage, all its products are made at once.
DENSE = 16
#: Of the product of two lengths: a bound of all rounding of rotation and partial products, some 1e-13 for 512 components.
SLACK = 1e-10
OPEN = 2**62


def second_moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of v v' over all rows, of the first ``ROTATED`` components: as many numbers reach the driver as it has."""
    w = min(width, ROTATED)

    def add(batches):
        total = np.zeros((w, w))
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                x = _matrix(batch.column(0).slice(a, PART), width)[:, :w].astype(float)
                total += x.T @ x
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "x"])

    out = np.zeros(w * w)
    for place, x in rows.select("v").mapInArrow(add, "place long, x double").groupBy("place").agg(F.sum("x")).collect():
        out[place] = x
    return out.reshape(w, w)


def rotation(moments: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes, the largest first."""
    return np.linalg.eigh(moments)[1][:, ::-1]


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Side:
    """Rows with their rotated vectors, and the lengths of what lies behind each stage of leading components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, axes: np.ndarray):
        self.rows, self.ids, self.labels, self.v = rows, ids, labels, v
        w = len(axes)
        self.y, x = v[:, :w] @ axes, v.astype(float)
        self.stages = sorted({max(1, w // 4), max(1, w // 2)})
        tail = np.einsum("ij,ij->i", x[:, w:], x[:, w:])
        self.rest = [np.sqrt(np.einsum("ij,ij->i", self.y[:, m:], self.y[:, m:]) + tail) for m in self.stages]
        self.length = np.sqrt(np.einsum("ij,ij->i", x, x))

    def part(self, a: int, b: int) -> Side:
        out = object.__new__(Side)
        out.rows, out.ids, out.labels, out.v, out.y, out.length = (x[a:b] for x in (self.rows, self.ids, self.labels, self.v, self.y, self.length))
        out.stages, out.rest = self.stages, [r[a:b] for r in self.rest]
        return out


class Windows:
    """What is sought: for each window an anchor (its place in a tile), the least and the greatest score, and the best k found."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.least = np.full(len(anchor), -np.inf)  # below this nothing is among the best
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))  # window, id, score

    def add(self, window: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        w, i, s = (np.concatenate(x) for x in zip(self.found, (window, ids, scores)))
        order = np.lexsort((i, -s, w))
        w, i, s = w[order], i[order], s[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        best = place < self.k
        self.found = w[best], i[best], s[best]
        full = place == self.k - 1
        self.least[w[full]] = s[full]


def seek(asked: Side, given: Side, windows: Windows, same: bool) -> int:
    """Adds the rows of ``given`` to windows: rows of the anchor's label but itself, or of other labels. Returns the integer products made."""
    made = 0
    for a in range(0, len(given.rows), PART):
        part = given.part(a, a + PART)
        m = asked.stages[0]
        product = asked.y[:, :m] @ part.y[:, :m].T
        margin = np.outer(asked.rest[0], part.rest[0]) + SLACK * np.outer(asked.length, part.length)
        below, above = product - margin, product + margin
        right = asked.labels[:, None] == part.labels
        right = right & (asked.rows[:, None] != part.rows) if same else ~right
        exact = None
        for b in range(0, len(windows.anchor), TILE):
            q, low, high, least = (x[b : b + TILE] for x in (windows.anchor, windows.low, windows.high, windows.least))
            up, down = above[q], below[q]
            may = right[q] & (up >= low[:, None]) & (down <= high[:, None])
            if np.isneginf(least).any() and len(part.rows) > windows.k:
                # k rows that are surely in the window bound from below what the best ones reach.
                sure = np.where(may & (down >= low[:, None]) & (up <= high[:, None]), down, -np.inf)
                least = np.maximum(least, np.partition(sure, -windows.k, axis=1)[:, -windows.k])
            may &= up >= least[:, None]
            if np.count_nonzero(may) * DENSE > may.size:  # hardly a row is ruled out: all products of the tile at once
                if exact is None:
                    exact = _products(asked, part)
                    made += exact.size
                _choose(exact, part, windows, b, may, np.maximum(least, low))
                continue
            w, c = np.nonzero(may)
            floor = np.maximum(least, low)
            for s in range(0, len(w), PAIRS):
                made += _verify(asked, part, windows, b + w[s : s + PAIRS], c[s : s + PAIRS], product, floor[w[s : s + PAIRS]])
    return made


def _products(asked: Side, part: Side) -> np.ndarray:
    """All integer products of two sides; by floating point where every partial sum is an integer that it holds exactly."""
    if asked.length.max(initial=0) * part.length.max(initial=0) < 2**52:
        return asked.v.astype(float) @ part.v.astype(float).T
    return asked.v @ part.v.T


def _choose(exact: np.ndarray, part: Side, windows: Windows, begin: int, may: np.ndarray, floor: np.ndarray) -> None:
    """Adds what is best of the rows that may be in the windows from ``begin`` on, by their integer products."""
    score = exact[windows.anchor[begin : begin + len(may)]]
    fits = may & (score >= floor[:, None]) & (score <= windows.high[begin : begin + len(may), None])
    many = np.flatnonzero(np.count_nonzero(fits, axis=1) > 4 * windows.k)
    if len(many):
        best = np.partition(np.where(fits[many], score[many], -np.inf), -windows.k, axis=1)[:, -windows.k]
        fits[many] &= score[many] >= best[:, None]
    w, c = np.nonzero(fits)
    windows.add(begin + w, part.ids[c], score[w, c].astype(np.int64))


def _verify(asked: Side, part: Side, windows: Windows, w: np.ndarray, c: np.ndarray, product: np.ndarray, floor: np.ndarray) -> int:
    """Takes pairs of a window and a row through the later stages and their integer products."""
    q, at = windows.anchor[w], product[windows.anchor[w], c]
    for stage in range(1, len(asked.stages)):
        begin, end = asked.stages[stage - 1 : stage + 1]
        at = at + np.einsum("ij,ij->i", asked.y[q, begin:end], part.y[c, begin:end])
        margin = asked.rest[stage][q] * part.rest[stage][c] + SLACK * asked.length[q] * part.length[c]
        on = (at + margin >= floor) & (at - margin <= windows.high[w])
        w, c, q, at, floor = w[on], c[on], q[on], at[on], floor[on]
    score = np.einsum("ij,ij->i", asked.v[q], part.v[c])
    on = (score >= windows.low[w]) & (score <= windows.high[w]) & (score >= windows.least[w])
    windows.add(w[on], part.ids[c[on]], score[on])
    return len(score)


def _met(given: DataFrame, asked: DataFrame, blocks: int, width: int, axes: np.ndarray, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(row, p, id, score): the best k of each block of ``given`` for each window of ``asked``.

    asked: (row, id, label, v, scores array<long>); a window for each score, p its place in the array. With ``same`` there is one
    open window for each anchor.
    """
    held = given.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("c"), F.lit(False).alias("asks"), "row", "id", "label", "v", F.lit(None).cast("array<long>").alias("scores"))
    # Each anchor meets every block: stated queries against all rows, in blocks.
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), F.lit(True).alias("asks"), "row", "id", "label", "v", "scores")
    together = held.unionByName(sent).repartitionById(blocks, "c").sortWithinPartitions("c", "asks")
    schema = pa.schema([("row", pa.int64()), ("p", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def side(pieces: list[pa.RecordBatch]) -> Side:
        table = pa.Table.from_batches(pieces)
        rows, ids, labels = (table.column(x).to_numpy() for x in ("row", "id", "label"))
        return Side(rows, ids, labels, _matrix(table.column("v").combine_chunks(), width), axes)

    def answer(block: Side, tile: pa.RecordBatch):
        anchors = side([tile])
        if same:
            n = len(anchors.rows)
            windows, p = Windows(np.arange(n), np.full(n, -OPEN), np.full(n, OPEN), k), np.zeros(n, np.int32)
        else:
            scores = tile.column("scores")
            many = scores.value_lengths().to_numpy(zero_copy_only=False)
            flat = scores.flatten().to_numpy(zero_copy_only=False)
            p = (np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
            windows = Windows(np.repeat(np.arange(len(many)), many), -((-low * flat) // 100), (high * flat) // 100, k)
        seek(anchors, block, windows, same)
        w, ids, found = windows.found
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((anchors.rows[windows.anchor[w]], p[w], ids, found), schema)], schema=schema)

    def meet(batches):
        now, held, block = None, [], None
        for batch in batches:
            c, asks = batch.column("c").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(c)]):
                if c[a] != now:
                    now, held, block = c[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if block is None and held:
                    block, held = side(held), []
                for t in range(a, b if block else a, TILE):
                    yield answer(block, batch.slice(t, min(TILE, b - t)))

    return together.mapInArrow(meet, "row long, p int, id long, score long")


def _first(found: DataFrame, k: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hardest negatives of each anchor and positive.

    Anchors are the rows of (vec_id, embedding, label) whose vec_id is divisible by ``every``. Scores are inner products of
    floor(scale * x), the highest first, ties by smaller vec_id. An anchor's positives are its first other rows of its label; a
    positive's negatives are the first rows of other labels with low * positive_score <= 100 * score <= high * positive_score
    (none, where positive_score < 0). All, where there are fewer.

    label is an integer. Rows with a null label, vec_id or vector, or a component null or not finite, take no part; vectors of
    different length are compared as if filled with zeros; too long ones are an error (``integer_vectors``). Rows that repeat a vec_id are rows each, as
    anchors, positives and negatives. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    kept = integer_vectors(vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")), scale, "label").filter("id IS NOT NULL AND label IS NOT NULL")
    rows = scratch.write(kept.withColumn("row", F.monotonically_increasing_id()), "rows")  # written, so a row keeps its number
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    axes = rotation(second_moments(rows, width))
    blocks = max(1, -(-n * width // BLOCK_VALUES), min(-(-n // LEAST_ROWS), 2 * partitions(spark)))
    anchors = rows.filter(F.col("id") % every == 0)
    met = _met(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), blocks, width, axes, positives, True, low, high)
    best = scratch.write(_first(met, positives, "row"), "positives")
    each = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))  # at most ``positives`` of a row
    asked = anchors.join(each, "row").withColumn("scores", F.col("best.score"))
    found = _first(_met(rows, asked, blocks, width, axes, negatives, False, low, high), negatives, "row", "p")
    about = best.select("row", (F.col("rank") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return found.join(about, ["row", "p"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows in DuckDB, after the relabelling of the query.
ORACLE_SQL = """
WITH r AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.row, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM r a JOIN r b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id) AS p FROM s WHERE same QUALIFY p <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.row, p.p ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
             s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.row = s.row WHERE NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""
