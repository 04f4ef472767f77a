"""Mixing sources to target weights by the cube method (balanced sampling).

A document of a source with target t and total size s is wanted t / s times: the whole part in full copies, the
fraction as an inclusion probability. The flight phase moves the probabilities of three documents at a time along the
null space of two balancing equations (total of words, number of documents) until one of them is 0 or 1, so both totals
of a source stay exactly as they were. Documents are dealt to buckets of about ``BUCKET`` rows of one source; each
bucket flies alone and leaves at most two documents open, and what is open flies again, level by level, until one
bucket of a source is left. Its flight spares ``LANDING`` documents, spread evenly over the order of size: the landing
takes, of all ways to round these and the open ones, that with the smallest error of the word total (then of the
document count).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from ._joins import told
from ._shared import Scratch

BUCKET = 1024
LANDING = 12
#: The key of a null source; others are "=" and the source.
NO_SOURCE = ""
WORDS = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Number of words in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_plan(totals: DataFrame, weights, share: float, most: float, scratch: Scratch) -> DataFrame:
    """(skey, n, source_size, target, whole, p) of (skey, n, words) of each source: its target, and each document's whole copies and probability.

    Sources in code-point order, null last, take the weights in turn. share * all words are dealt by weight; a source stops at most *
    its size and the rest is dealt again, until none is above. A round brings two sums to the driver, never a source.
    """
    ordered = numbered(totals.withColumn("last", F.col("skey") == NO_SOURCE), ["last", "skey"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    plan = scratch.write(ordered.select("skey", "n", F.col("words").alias("source_size"), weight.alias("weight"), (F.lit(float(most)) * F.col("words")).alias("top")), "sources")
    everything, unit, capped = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        over = F.lit(unit) * F.col("weight") > F.col("top")
        now, full, open_ = plan.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        if now == capped or not open_:
            break
        unit, capped = (share * everything - full) / open_, now
    target = F.least(F.lit(unit) * F.col("weight"), F.col("top"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + _NEAR)
    p = F.when(rate - whole > _NEAR, rate - whole).otherwise(0.0)
    return plan.withColumn("target", target).select("skey", "n", "source_size", "target", whole.cast("int").alias("whole"), p.alias("p"))


def _step(p: list, u: tuple, draw: float) -> None:
    """Moves p along u or against it, to where one of them is 0 or 1, without changing its expectation."""
    ahead = min((1 - x) / d if d > 0 else -x / d for x, d in zip(p, u) if d)
    back = min(x / d if d > 0 else (x - 1) / d for x, d in zip(p, u) if d)
    move = ahead if draw * (ahead + back) < back else -back
    for i, d in enumerate(u):
        x = p[i] + move * d
        p[i] = 0.0 if x < _NEAR else 1.0 if x > 1 - _NEAR else x


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Probabilities after the flight phase over units in the given order; with land, all 0 or 1.

    Sums of p and of size * p stay as they were, but for what landing adds or takes. Units come largest first.
    """
    p = p.astype(float).copy()
    x, draws = size.astype(float).tolist(), rng.random(len(p)).tolist()
    left = [int(i) for i in np.flatnonzero((p > _NEAR) & (p < 1 - _NEAR))]
    spared = [left[i] for i in np.unique(np.linspace(0, len(left) - 1, LANDING).astype(int))] if land and left else []
    left = sorted(set(left) - set(spared))
    p[p <= _NEAR], p[p >= 1 - _NEAR] = 0, 1
    active: list[int] = []
    for i in left:
        active.append(i)
        if len(active) == 3:
            a, b, c = active
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            q = [p[a], p[b], p[c]]
            _step(q, u if any(u) else (1.0, -1.0, 0.0), draws[i])
            p[a], p[b], p[c] = q
            active = [j for j in active if 0 < p[j] < 1]
    if open_ := active + spared if land else []:
        ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        change = ways - p[open_]
        words, documents = np.abs(change @ size[open_].astype(float)), np.abs(change.sum(1))
        p[open_] = ways[np.lexsort((documents.round(6), words.round(6)))[0]]
    return p


def _level(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One flight over units dealt to buckets; a source with one bucket lands."""
    counts = units.groupBy("skey").agg(F.count("*").alias("n")).withColumn("b_count", F.ceil(F.col("n") / BUCKET).cast("int"))
    dealt = told(units, counts, "skey", units.count())
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("row_key", "doc_id", "size", "nth", F.lit(level)), F.col("b_count")).cast("int")).withColumn("lands", F.col("b_count") == 1).drop("b_count").select(*units.columns, "bucket", "lands")

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: those left open are small.
        pdf = pdf.sort_values(["size", "row_key", "nth"], ascending=[False, True, True], kind="stable", ignore_index=True)
        name = pdf["skey"].iloc[0]
        code = zlib.crc32(name[1:].encode()) if name != NO_SOURCE else 1 << 32
        rng = np.random.default_rng([seed, level, code, int(pdf["bucket"].iloc[0])])
        pdf["p"] = flight(pdf["size"].to_numpy(), pdf["p"].to_numpy(), rng, bool(pdf["lands"].iloc[0]))
        return pdf.drop(columns=["bucket", "lands"])

    return dealt.groupBy("skey", "bucket").applyInPandas(fly, units.schema)


def balanced_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies and row_key for every row of (doc_id, text, source).

    Size is the number of words (null text: 0). Sources in code-point order, null last, take the weights in turn;
    together they share ``share`` times all words, each at most ``most`` times its own. taken = copies * size, and a
    source's taken words differ from its target by what the landing can't even out, less than one small document. row_key is a hash of the row's
    columns; identical rows are decided each for itself, and documents without words too. Reruns agree. Sources are rows of tables
    throughout, however many there are. An empty table gives no rows; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    units = docs.select(row_key(docs).alias("row_key"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(NO_SOURCE)).alias("skey"), word_count(F.col("text").cast("string")).alias("size"))
    # doc_id travels as text: pandas has no integer that may be null. Identical rows are counted, then numbered.
    units = units.groupBy(*units.columns).agg(F.count("*").alias("n"))
    units = scratch.write(units.select("row_key", "doc_id", "skey", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")), "sizes")
    totals = units.groupBy("skey").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    state = told(units, source_plan(totals, weights, share, most, scratch), "skey", units.count())
    state = scratch.write(state, "planned")
    done, level = [state.filter("p = 0")], 0
    state = state.filter("p > 0")
    while not state.isEmpty():
        state = scratch.write(_level(state, level, seed), f"level{level}")
        done.append(state.filter("p = 0 or p = 1"))
        state, level = state.filter("p > 0 and p < 1"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.col("p")).cast("long")
    source = F.when(F.col("skey") != NO_SOURCE, F.substring("skey", 2, 2**31 - 1))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), source.alias("source"), copies.alias("copies"), "row_key")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.col(c) for c in ("doc_id", "text", "source")))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; an empty table gives no rows.

    Rows with equal doc_id, text and source get together what the mix takes of them, each its share.
    """
    scratch = Scratch(docs.sparkSession, "mixed-rows")
    taken = balanced_mix(docs, **how).groupBy(F.col("row_key").alias("mix_key")).agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")).filter("mix_copies > 0")
    taken = scratch.write(taken, "taken")
    packed = docs.select(row_key(docs).alias("mix_row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"))
    match = F.col("mix_row_key") == F.col("mix_key")
    out = packed.join(taken.filter("mix_rows = 1"), match).select("mix_row", "mix_copies")
    repeated = taken.filter("mix_rows > 1")
    if repeated.count():
        # Numbers of equal rows, in two levels: within a salt, and before it.
        salted = scratch.write(packed.join(repeated, match).drop("mix_row_key").withColumn("mix_salt", F.monotonically_increasing_id() % 256), "repeated")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("mix_key").orderBy("mix_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        salts = salted.groupBy("mix_key", "mix_salt").agg(F.count("*").alias("n")).select("mix_key", "mix_salt", before.alias("mix_before"))
        nth = F.row_number().over(Window.partitionBy("mix_key", "mix_salt").orderBy("mix_salt")) + F.col("mix_before") - 1
        share = F.floor(F.col("mix_copies") / F.col("mix_rows")) + (nth < F.col("mix_copies") % F.col("mix_rows")).cast("int")
        out = out.unionByName(salted.join(salts, ["mix_key", "mix_salt"]).select("mix_row", share.alias("mix_copies")).filter("mix_copies > 0"))
    return out.select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("mix_row.*")
