"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

1. Signatures. Each document's distinct word shingles are hashed once to 64 bits. The range of the hash is cut into
   ``bins`` equal bins, of which each keeps its least hash; an empty bin takes over the bin that a 2-universal sequence
   of its own reaches first (optimal densification). A fingerprint of the sorted set names documents with equal sets.
2. Classes. Documents with equal sets are one class, a node of the graph; one text of each goes on.
3. Buckets. Runs of ``rows`` signature values are hashed to band keys; nodes that share a key share a bucket.
4. Stars. In a bucket only edges from a hub (its smallest member) to the others are candidates, so a bucket of n
   members has n - 1 candidates. Candidates are confirmed on full shingle sets, confirmed ones joined to components.
5. Rest. A bucket whose members are not yet in one component may hide a link between two that are no hub. Members of
   such buckets that share them, directly or over others, are a cluster. In a cluster the largest component is told
   from the other members; both are dealt to bands of set size, of which only neighbours can hold similar sets, and to
   blocks of about ``BLOCK``, and every pair of blocks that may hold a link between components is compared in full at
   once, by a product of its document-shingle matrices. So every pair that shares a bucket is confirmed, refuted, or
   already connected, without a cap on members or partners; rows moved are members times blocks, never pairs.

Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, partitions
from ._text import hash_words, mix, slices

#: Members of one hub that are confirmed in one group, which holds the hub's set and reads the others one by one.
STAR = 256
BLOCK = 256
#: Up to so many requested documents (40 bytes each) are broadcast to the scan of the texts; more are joined by shuffle.
BROADCAST_REQUESTS = 200_000
#: Classes that are broadcast by name in the last join have at least so many documents, and at least a share 1 / HOT_CLASSES.
HOT_ROWS, HOT_CLASSES = 1000, 100_000


def shingle_sets(texts: pa.Array, words: int):
    """Sorted distinct shingle hashes of each text of a column, in order. Fewer words than a shingle: all of them as one."""
    power = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for a, b, data, offsets in slices(texts):
        h, counts = hash_words(data, offsets)
        n = len(h) - words + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            if n > 0:
                rolled += h[k : k + n] * power[k]
        rolled = mix(rolled)
        ends = np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            if end - start >= words:
                yield np.unique(rolled[start : end - words + 1])
            elif end > start:
                few = h[start:end] * power[: end - start]
                yield mix(np.array([few.sum(dtype=np.uint64) + np.uint64(end - start)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _attempts(bins: int, tries: int = 64) -> np.ndarray:
    """Bins that an empty bin tries one after another."""
    step = np.arange(bins * tries, dtype=np.uint64)
    return (mix(step + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash of sorted non-empty sets, densified: a row for each set."""
    edges = (np.arange(bins + 1, dtype=object) * (1 << 64) // bins)[:-1].astype(np.uint64)
    out, filled = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        end = np.append(at[1:], len(s))
        full = at < end
        out[i, full], filled[i] = s[at[full]], full
    tries = _attempts(bins)
    rows, cols = np.nonzero(~filled)
    for t in range(4096):
        if not len(rows):
            return out
        if t < len(tries):
            source = tries[t][cols]
        else:
            source = (mix(np.uint64(t * bins) + cols.astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        hit = filled[rows, source]
        out[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    out[rows, cols] = out[rows, filled[rows].argmax(1)]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    power = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = (signature[:, : bands * rows].reshape(len(signature), bands, rows) * power).sum(2, dtype=np.uint64)
    return mix(keys + mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)))


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, fingerprint of the set, and its band keys (none for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fingerprint", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches):
        for batch in batches:
            done, held = 0, []

            def rows_of(held, done):
                full = [i for i, s in enumerate(held) if len(s)]
                keys = band_keys(signatures([held[i] for i in full], bands * rows), bands, rows).view(np.int64) if full else []
                lists: list = [None] * len(held)
                for i, k in zip(full, keys):
                    lists[i] = k.tolist()
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in held]
                names = [c.slice(done, len(held)) for c in batch.columns[:2]]
                return pa.RecordBatch.from_arrays([*names, pa.array([len(s) for s in held], pa.int64()), pa.array(marks, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

            for s in shingle_sets(batch.column(2), words):
                held.append(s)
                if len(held) == 256:
                    yield rows_of(held, done)
                    done, held = done + 256, []
            if held:
                yield rows_of(held, done)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, fingerprint binary, bands array<long>")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, rows with a node, with the text of one of its documents; small requests are broadcast to the scan."""
    asked = wanted.join(classes.select("node", F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    few = wanted.count() <= BROADCAST_REQUESTS
    return texts.join(F.broadcast(asked) if few else asked, (F.col("doc_id") == F.col("d_id")) & (F.xxhash64("text") == F.col("d_hash"))).select(*wanted.columns, "text")


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Of (hub, member), the pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    Pairs whose set sizes rule that out are dropped before any text is read.
    """
    sizes = classes.select(F.col("node").alias("s_node"), "n_shingles")
    sized = pairs.join(sizes.withColumnsRenamed({"s_node": "hub", "n_shingles": "h_size"}), "hub").join(sizes.withColumnsRenamed({"s_node": "member", "n_shingles": "m_size"}), "member")
    pairs = sized.filter(100 * F.least("h_size", "m_size") >= percent * F.greatest("h_size", "m_size")).select("hub", "member")
    stars = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).alias("stars"))
    dealt = pairs.join(stars, "hub").withColumn("star", F.pmod(F.xxhash64("member"), F.col("stars"))).select("hub", "star", "member")
    hubs = dealt.select("hub", "star", F.col("hub").alias("node")).distinct()
    found = _texts(docs, classes, dealt.select("hub", "star", F.col("member").alias("node")).unionByName(hubs))
    ordered = found.repartition(partitions(docs.sparkSession), "hub", "star").sortWithinPartitions("hub", "star", (F.col("node") != F.col("hub")).cast("int"), "node")

    def check(batches):
        at, base = None, None
        for batch in batches:
            hub, star, ids = (batch.column(i).to_pylist() for i in range(3))
            linked: tuple[list, list] = ([], [])
            for h, r, i, s in zip(hub, star, ids, shingle_sets(batch.column(3), words)):
                if i == h:
                    at, base = (h, r), s
                elif at == (h, r):
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(s) - both):
                        linked[0].append(h)
                        linked[1].append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(linked[0], pa.int64()), "b": pa.array(linked[1], pa.int64())})

    return ordered.mapInArrow(check, "a long, b long").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of 0/1 matrices of at most ``cells`` cells."""
    n, m = len(left), len(right)
    sets = [*left, *right]
    owner = np.repeat(np.arange(n + m), [len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    sides = np.bincount(place[owner < n], minlength=place.max() + 1), np.bincount(place[owner >= n], minlength=place.max() + 1)
    shared = (sides[0] > 0) & (sides[1] > 0)
    column = (np.cumsum(shared) - 1)[place]
    owner, column = owner[shared[place]], column[shared[place]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, m), np.int64)
    step = max(1, cells // (n + m))
    for first in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [first, first + step])
        matrix = np.zeros((n + m, step), np.float32)
        matrix[owner[a:b], column[a:b] - first] = 1
        out += (matrix[:n] @ matrix[n:].T).astype(np.int64)
    return out


def _within(left: tuple, right: tuple | None, percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different labels, of (nodes, labels, sets) on the left with those on the right, or among themselves.

    Only those that join labels not yet joined here.
    """
    other = right or left
    both = intersections(left[2], other[2])
    linked = 100 * both >= percent * (np.array([[len(s)] for s in left[2]]) + np.array([len(s) for s in other[2]]) - both)
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(linked if right else np.triu(linked, 1)).tolist():
        x, y = find(left[1][i]), find(other[1][j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((left[0][i], other[0][j]))
    return out


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of nodes: their sets as bytes."""

    def sets(batches):
        for batch in batches:
            node = batch.column(0)
            for i, s in enumerate(shingle_sets(batch.column(1), words)):
                yield pa.RecordBatch.from_arrays([node.slice(i, 1), pa.array([s.tobytes()], pa.binary())], names=["node", "shingles"])

    return _texts(docs, classes, nodes).mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])


def _clusters(labelled: DataFrame, docs: DataFrame, classes: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components within clusters of torn buckets; labelled: (key, node, label)."""
    torn = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("node").alias("hub")).filter("x <> y").select("key", "hub")
    rest = scratch.write(labelled.join(torn, "key").select("node", "label", "hub").distinct(), "torn")
    cluster = components(rest.select(F.col("node").alias("a"), F.col("hub").alias("b")), scratch, "clusters").withColumnRenamed("node", "c_node")
    people = rest.select("node", "label").distinct().join(cluster, F.col("node") == F.col("c_node"), "left").select("node", "label", F.coalesce("component", "node").alias("cluster"))
    # Similar sets are of the same band of sizes, or of bands next to one another.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / (max(math.log(100 / percent), 1e-6) * (1 + 1e-9)))
    people = scratch.write(people.join(classes.select("node", band.alias("band")), "node"), "cluster-members")
    by_label = people.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("main")).select("cluster", F.col("main.label").alias("main"))
    people = people.join(main, "cluster").withColumn("apart", F.col("label") != F.col("main"))
    sizes = people.groupBy("cluster", "band").agg(F.ceil(F.count_if("apart") / BLOCK).cast("int").alias("others"), F.ceil(F.count_if(~F.col("apart")) / BLOCK).cast("int").alias("mains"))
    dealt = people.join(sizes, ["cluster", "band"])
    for name, by in (("up", 1), ("down", -1)):
        near = sizes.select("cluster", (F.col("band") - by).alias("band"), F.col("others").alias(f"{name}_others"), F.col("mains").alias(f"{name}_mains"))
        dealt = dealt.join(near, ["cluster", "band"], "left")
    # Blocks 0 to others - 1 of a band hold the smaller components, the blocks after them the main one.
    salt = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    block = F.when(F.col("apart"), salt(F.col("others"))).otherwise(F.col("others") + salt(F.col("mains"))).cast("int")
    dealt = dealt.withColumn("block", block)

    def partners(others: str, mains: str, pair):
        n = F.coalesce(F.col(others) + F.when(F.col("apart"), F.col(mains)).otherwise(0), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pair), n

    lists = [
        partners("others", "mains", lambda j: F.struct(F.col("band").alias("b"), F.lit(0).alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), (F.col("block") > j).cast("int").alias("side"))),
        partners("up_others", "up_mains", lambda j: F.struct(F.col("band").alias("b"), F.lit(1).alias("kind"), F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        partners("down_others", "down_mains", lambda j: F.struct((F.col("band") - 1).alias("b"), F.lit(1).alias("kind"), j.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))),
    ]
    sent = dealt.select("cluster", "label", "node", F.explode(F.concat(*(F.when(n > 0, pairs).otherwise(F.slice(pairs, 1, 0)) for pairs, n in lists))).alias("p"))
    sent = sent.select("cluster", "p.*", "node", "label")
    sets = scratch.write(_sets(docs, classes, people.select("node").distinct(), words), "sets", "lz4")
    key = ["cluster", "b", "kind", "i", "j"]
    ordered = sent.join(sets, "node").select(*key, "side", "node", "label", "shingles").repartition(partitions(docs.sparkSession), *key).sortWithinPartitions(*key, "side", "node")

    def compare(batches):
        at, held = None, []

        def close():
            left, right = (tuple(zip(*(x[1:] for x in held if x[0] == side))) for side in (0, 1))
            made = _within(left, None if at[3] == at[4] and at[2] == 0 else right, percent) if left and (right or at[3] == at[4] and at[2] == 0) else []
            held.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in made], pa.int64()), "b": pa.array([y for _, y in made], pa.int64())})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for k, row in enumerate(zip(*columns)):
                if row[:5] != at:
                    if held:
                        yield close()
                    at = row[:5]
                held.append((*row[5:], np.frombuffer(batch.column(8)[k].as_py(), np.uint64)))
        if held:
            yield close()

    return ordered.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the smallest node that each node reaches.

    Alternates large-star and small-star steps on the edges, each a grouped minimum and a join, until nothing changes;
    the edges become stars around the smallest nodes. Steps are written, so a lost executor costs one step.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    mark, step, last = None, 0, None
    edges = scratch.write(edges, f"{name}edges")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = scratch.write(small, f"{name}{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last:
            scratch.drop(last)
        last, step = f"{name}{step}", step + 1
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, bands: int = 26, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) for every row of (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct word shingles; component_id
    is the smallest doc_id reachable, kept marks it. A document with fewer words than a shingle has all of them as one;
    one without words or with null text has an empty set and is linked with nothing. Rows are linked by their own texts, also
    where they share a doc_id; a null doc_id is never linked: component_id null, kept true. A pair of similarity s
    shares no bucket with probability (1 - s ** rows) ** bands: 2e-7 at 0.85 with the defaults. An empty table gives no
    rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.write(_signed(docs, words, bands, rows), "signed")
    sets = signed.filter("doc_id is not null and fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "bands")).alias("r"), F.count("*").alias("n"))
    classes = scratch.write(sets.select("fingerprint", F.xxhash64("fingerprint").alias("node"), "r.*", "n"), "classes")
    members = classes.select("node", F.explode("bands").alias("key"))
    stars = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = scratch.write(members.join(stars, "key").select("key", "node", "hub"), "buckets")
    pairs = scratch.write(shared.filter("node <> hub").select("hub", F.col("node").alias("member")).distinct(), "pairs0")
    links = scratch.write(confirm(pairs, docs, classes, words, percent), "links")
    joined = components(links, scratch, "starred")
    labelled = shared.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    more = scratch.write(_clusters(labelled, docs, classes, scratch, words, percent), "more-links")
    # What is joined so far stands for the links it came from.
    joined = components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch, "joined")
    # A component is named by its smallest doc_id. The smallest node stands for itself.
    named = classes.select("fingerprint", "node", "doc_id", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.select("node", "component").unionByName(joined.select(F.col("component").alias("node"), "component").distinct()).join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("c_id"))
    named = named.join(smallest, "component", "left").filter("n > 1 or c_id is not null").select("fingerprint", "n", F.coalesce("c_id", "doc_id").alias("c_id"))
    named = scratch.write(named, "names")
    scratch.drop_all_but("signed", "names")
    hot = F.col("n") >= max(HOT_ROWS, signed.count() // HOT_CLASSES)
    lone = F.col("doc_id").isNull() | F.col("fingerprint").isNull()
    told = signed.drop("bands").join(F.broadcast(named.filter(hot).select("fingerprint", F.col("c_id").alias("hot_id"))), "fingerprint", "left")
    # Rows without a set or id, and those of hot classes, need no shuffle.
    easy = told.filter(lone | F.col("hot_id").isNotNull()).withColumn("c_id", F.when(~lone, F.col("hot_id")))
    out = easy.unionByName(told.filter(~lone & F.col("hot_id").isNull()).join(named.filter(~hot).drop("n"), "fingerprint", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
