"""Clustering and hard negatives on vectors against brute force, with ties, repeats, nulls and odd lengths."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from foldspark.llm import hard_negatives as hn
from foldspark.llm.exponion import Centroids, cluster_digest, exponion, squared

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Vectors with columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, row int, cluster string")


def lloyd(rows, width, k, rounds, scale, salt):
    """Plain k-means as stated, all distances each round."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        at = [[sum(x) // len(x) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = defaultdict(int)
    for _, j, d in found:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, sums[j], sum(sums.values()), sha[j]) for i, j, d in found]


@pytest.mark.parametrize("seed", range(3))
def test_exponion_is_lloyd(spark, monkeypatch, seed):
    monkeypatch.setattr("foldspark.llm.exponion.BLOCK", 16)
    rng = np.random.default_rng(seed)
    grid = rng.integers(-3, 4, (150, 3)) / (8 if seed else 4)  # many equal distances and vectors
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(grid)]
    rows += [rows[5], rows[5], (7, [9.0, 9.0, 9.0], None), (None, [0.1, 0.2, 0.3], 1), (8, None, 1), (9, [1.0, None, 1.0], 1), (10, [1.0, NAN, 1.0], 1), (11, [INF, 0.0, 0.0], 1), (12, [1.0, 1.0], 1)]
    want = lloyd(rows, 3, 5, 6, 16, "s")
    got = cluster_digest(exponion(table(spark, rows), 3, 5, 6, 16, "s")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_exponion_of_few(spark):
    few = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [5.0, 5.0], 0)]
    got = cluster_digest(exponion(table(spark, few), 2, 8, 10, 4)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(lloyd(few, 2, 8, 10, 4, "3:"), key=repr)
    assert cluster_digest(exponion(table(spark, [(1, None, 0)]), 2)).collect() == []
    with pytest.raises(Exception, match="too long"):
        exponion(table(spark, [(1, [1e300, 0.0], 0)]), 2)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(3000, 8)) * 40 + rng.integers(0, 6, (3000, 1)) * 300).astype(np.int64)
    at = Centroids(x[:12])
    cluster, upper, lower = at.scan(x)
    scanned = 0
    for _ in range(8):
        new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) for j in range(12)])
        at = Centroids(new, at.at)
        cluster, upper, lower, seen = at.assign(x, cluster, upper, lower)
        scanned += seen
        d = np.stack([squared(x, c) for c in at.at], 1)
        assert (cluster == d.argmin(1)).all()
        assert (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(np.sort(d, 1)[:, 1])).all()
    assert scanned < 8 * 3000 * 12 / 3


def mined(rows, every, positives, negatives, low, high, scale):
    kept = [(n, i, [int(np.floor(scale * x)) for x in v], y) for n, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v, y in kept:
        if i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m, z) for m, j, w, z in kept if m != n))
            for s, j, _, _ in [r for r in scored if r[3] == y][:positives]:
                fits = [r for r in scored if r[3] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
                out += [(i, j, k, r[1], -s, -r[0]) for k, r in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "grid", "ragged"])
def test_hard_negatives(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    for name, value in (("PART", 32), ("TILE", 3), ("PAIRS", 50), ("LEAST_ROWS", 64), ("ROTATED", 6)):
        monkeypatch.setattr(hn, name, value)
    x = rng.integers(-2, 3, (240, 8)) / 4 if kind == "grid" else rng.normal(size=(240, 8)) * [3, 2, 1, 1, 0.5, 0.5, 0.2, 0.1] + 0.6
    rows = [(int(i), v.tolist()[: 3 + i % 6 if kind == "ragged" else 8], int(i % 3)) for i, v in enumerate(x)]
    rows += [rows[20], rows[20], (20, x[3].tolist(), 1), (40, x[4].tolist(), None), (None, x[5].tolist(), 1), (60, None, 1), (80, [1.0, NAN], 1), (100, [None], 2), (120, [], 0), (140, [INF], 0)]
    want = mined(rows, 20, 3, 4, 30, 90, 16)
    got = hn.hard_negatives(table(spark, rows), 20, 3, 4, 30, 90, 16)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_hard_negatives_of_few(spark):
    assert hn.hard_negatives(table(spark, [])).collect() == []
    one = [(100, [1.0, 1.0], 1), (1, [1.0, 1.0], 1)]
    assert hn.hard_negatives(table(spark, one)).collect() == []
    two = [*one, (2, [0.5, 0.5], 2)]
    assert [tuple(r) for r in hn.hard_negatives(table(spark, two)).collect()] == [(100, 1, 1, 2, 2 * 256**2, 256**2)]
    with pytest.raises(Exception, match="too long"):
        hn.hard_negatives(table(spark, [(1, [1e300], 0)]))


def test_rotation_leaves_few_products():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(4000, 32)) * 256 * 0.8 ** np.arange(32)).astype(np.int64)
    side = hn.Side(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), v, hn.rotation((v.T @ v).astype(float)))
    tile = side.part(0, 50)
    windows = hn.Windows(np.arange(50), np.full(50, -hn.OPEN), np.full(50, hn.OPEN), 5)
    assert hn.seek(tile, side, windows, True) < 50 * 4000 / 10
    scores = tile.v @ v.T
    scores[np.arange(50), np.arange(50)] = -hn.OPEN
    assert windows.found[2].reshape(50, 5).tolist() == (-np.sort(-scores, 1)[:, :5]).tolist()


def test_oracles(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from conftest import SMALL

    from foldspark.llm.queries import ORACLE_SQL, QUERIES

    d = duckdb.connect()
    d.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    for name in ("op12_exponion", "op13_hard_negatives"):
        want, got = d.sql(ORACLE_SQL[name]), QUERIES[name](spark, SMALL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
        assert [f.dataType.simpleString() for f in got.schema] == [{"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string"}[str(t)] for t in want.types]
